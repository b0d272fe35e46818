"""Decontamination, packing, records and media against brute force, round trips and made streams."""

import random
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest

from tidemark.llm import decontaminate, media, packing, records
from tidemark.llm.tokens import Tokens


def normal_words(text):
    return [(m.group().casefold(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]


def brute_passages(docs, items, n=decontaminate.NGRAM):
    out = set()
    for item, t in items:
        iw = [w for w, *_ in normal_words(t)]
        if len(iw) < decontaminate.SHORTEST:  # only as a whole text
            for row, text in enumerate(docs):
                w = normal_words(text or "")
                if iw and [x for x, *_ in w] == iw:
                    out.add((row, item, w[0][1], w[-1][2]))
            continue
        size = min(n, len(iw))
        grams = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)}
        for row, text in enumerate(docs):
            w = normal_words(text or "")
            open_ = None
            for i in range(len(w) - size + 1):
                if tuple(x for x, *_ in w[i : i + size]) in grams:
                    s, e = w[i][1], w[i + size - 1][2]
                    if open_ and s <= open_[1]:
                        open_[1] = e
                    else:
                        if open_:
                            out.add((row, item, *open_))
                        open_ = [s, e]
            if open_:
                out.add((row, item, *open_))
    return out


def test_passages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    rng = random.Random(1)
    for k, (_, t) in enumerate(items[:12]):
        w = t.split()
        part = " ".join(w[: rng.randrange(6, len(w))])
        rows.append((10_000 + k, f"Été déjà — {part.upper().replace(' ', ' *** ')}; fin. {part}"))
    rows += [(20_000, None), (20_001, ""), (None, items[0][1]), (20_002, items[1][1] * 2000), (20_003, items[2][1]), (20_003, items[2][1])]
    items += [(900, "Yes."), (901, "one two three four"), (902, None), (903, items[0][1]), (None, items[0][1])]
    rows += [(20_004, "She said: One, two, THREE four!"), (20_005, " «YES»! "), (20_006, "yes, yes")]
    got = decontaminate.contamination(spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, item string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(rows[r][0], item, s, e) for r, item, s, e in brute_passages([t for _, t in rows], [x for x in items if x[1]])}
    assert {tuple(r) for r in got} == want and want
    assert sum(r.doc_id == 20_003 and r.item_id == items[2][0] for r in got) == 2


def test_filter_and_parts(spark, monkeypatch):
    rng = random.Random(2)
    items = [(k, " ".join(f"b{rng.randrange(500)}" for _ in range(20))) for k in range(30)]
    rows = [(k, items[k][1] if k % 3 == 0 else f"clean text number {k} " * 9, k) for k in range(30)] + [(99, None, 1), (98, "", 1)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, text_ long"), spark.createDataFrame(items, "item_id long, text string")
    for size, one in ((decontaminate.PART_WORDS, decontaminate.ONE_LETTER), (60, 5)):
        monkeypatch.setattr(decontaminate, "PART_WORDS", size)
        monkeypatch.setattr(decontaminate, "ONE_LETTER", one)
        out = decontaminate.decontaminate(docs, bench)
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r[0] for r in rows if r[0] >= 98 or r[0] % 3}
        assert {r.doc_id for r in decontaminate.contamination(docs, bench).collect()} == {k for k in range(0, 30, 3)}
    assert decontaminate.contamination(docs, bench.limit(0)).collect() == [] == decontaminate.contamination(docs.limit(0), bench).collect()
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


PASSAGES = [
    "The quick brown fox jumps over the lazy dog today",
    "Съешь же ещё этих мягких французских булок да выпей чаю",
    "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία και άλλες τέτοιες λέξεις εδώ τώρα",
    "Une phrase déjà très élaborée où naïveté et œuvre près du cœur",
    "人人生而自由在尊严和权利上一律平等他们赋有理性和良心",
    "吾輩は猫である名前はまだ無いどこで生れたか頓と見当がつかぬ",
    "Große Straße und weiße Füße im Maß des Spaßes heute",
]


@pytest.mark.parametrize("wide", [False, True])
def test_passages_in_any_script(monkeypatch, wide):
    import unicodedata

    if wide:
        monkeypatch.setattr(decontaminate, "ONE_LETTER", 3)
    changes = [
        lambda t: t, str.upper, lambda t: t.replace(" ", "\u00a0"), lambda t: t.replace(" ", " — "), lambda t: unicodedata.normalize("NFD", t),
        lambda t: "“" + t.replace(" ", "” «") + "»", lambda t: t.replace("fi", "ﬁ").replace(" ", "…"), lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t),
    ]
    made = decontaminate.Patterns(list(enumerate(PASSAGES)) + [(100, "Да."), (101, "好"), (102, "")])
    texts, want = [], set()
    for k, t in enumerate(PASSAGES):
        for change in changes:
            x, before = change(t), "̀ÉTÉ 中 x: "
            texts.append(before + x + "\t. Конец")
            inner = [i for i, c in enumerate(x) if unicodedata.category(c)[0] in "LNM"]
            want.add((len(texts) - 1, k, len(before) + inner[0], len(before) + inner[-1] + 1))
    texts += ["", "ДА!", "так да", "“好”", "好好", None, "\ud7ff ok"]
    want |= {(len(texts) - 6, 100, 0, 2), (len(texts) - 4, 101, 1, 2)}
    spans = {}
    for row, item, s, e in made.matches(pa.array(texts)):
        of = spans.setdefault((row, item), [s, e])
        of[0], of[1] = min(of[0], s), max(of[1], e)
    assert {(r, i, s, e) for (r, i), (s, e) in spans.items()} == want


def test_long_texts_of_any_script():
    made = decontaminate.Patterns([(1, PASSAGES[1]), (2, PASSAGES[4])])
    text = ("слово " * 90_000 + PASSAGES[1].upper() + " " + "好" * 200_000 + PASSAGES[4]) * 2
    found = {(i, text[s:e].casefold() in (PASSAGES[1] + PASSAGES[4]).casefold()) for _, i, s, e in made.matches(pa.array([text]))}
    assert found == {(1, True), (2, True)}
    broken = pa.array([b"\xff\xfe " + PASSAGES[0].encode() + b" \xc3"]).cast(pa.binary()).view(pa.string())
    assert decontaminate.Patterns([(1, PASSAGES[0])]).matches(broken).__next__()[:2] == (0, 1)


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a chunk at a time, over a plain list of bins."""
    room, bins = [], []
    for n in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= n]
        if fits:
            k = min(fits)[1]
        else:
            room.append(capacity)
            bins.append([])
            k = len(room) - 1
        room[k] -= n
        bins[k].append(n)
    return sorted(map(tuple, bins))


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 30, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 50, 400]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.plan(counts, capacity)
    bins, spans = {}, {}
    for k, (length, rank, first, each, offset) in enumerate(runs):
        end = next((r for n, r, *_ in runs[k + 1 :] if n == length), counts[length])
        for q in range(end - rank):
            b, at = first + q // each, offset + q % each * length
            bins.setdefault(b, []).append(length)
            spans.setdefault(b, []).append((at, at + length))
    assert sorted(tuple(sorted(v, reverse=True)) for v in bins.values()) == one_by_one(lengths, capacity)
    for v in spans.values():
        v.sort()
        assert v[0][0] == 0 and all(a[1] == b[0] for a, b in zip(v, v[1:])) and v[-1][1] <= capacity


def test_segment_tree():
    rng = random.Random(3)
    tree, filled = packing.SegmentTree(100), set()
    for _ in range(3000):
        k = rng.randrange(101)
        on = rng.random() < 0.3
        tree.set(k, on)
        (filled.add if on else filled.discard)(k)
        q = rng.randrange(101)
        assert tree.first_from(q) == min((x for x in filled if x >= q), default=-1)


def test_packing(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    encode = Tokens(spark).encoding().encode_ordinary
    rows = [(r.doc_id, r.text, 1) for r in docs.collect()] + [(900, None, 1), (901, "", 1), (None, "no id", 1), (902, "twice", 1), (902, "twice", 1), (903, "long word " * 20_000, 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, bin_id int")
    for bucket in (packing.BUCKET_ROWS, 20):
        monkeypatch.setattr(packing, "BUCKET_ROWS", bucket)
        out = packing.pack(odd, capacity=256).collect()
        lengths = []
        for _, t, _ in rows:
            n = len(encode(t or ""))
            lengths += [256] * (n // 256) + ([n % 256] if n % 256 else [])
        bins = {}
        for r in out:
            bins.setdefault(r.bin_id, []).append(r)
        assert sorted(tuple(sorted((r.n_tokens for r in b), reverse=True)) for b in bins.values()) == one_by_one(lengths, 256)
        for b in bins.values():
            b.sort(key=lambda r: r.bin_offset)
            assert b[0].bin_offset == 0 and all(x.bin_offset + x.n_tokens == y.bin_offset for x, y in zip(b, b[1:]))
        for i, t, _ in rows[:20]:
            mine = sorted((r.token_start, r.n_tokens) for r in out if r.doc_id == i)
            assert sum(n for _, n in mine) == len(encode(t)) and all(s == 256 * k for k, (s, _) in enumerate(mine))
    assert packing.pack(odd.limit(0)).collect() == []


def test_checksum_vectors():
    data = [b"", b"123456789", bytes(32), b"\xff" * 32, bytes(range(32)), bytes(range(256)) * 9]
    raw = np.frombuffer(b"".join(data), np.uint8)
    end = np.cumsum([len(d) for d in data])
    got = records.crc32c(raw, end - [len(d) for d in data], end).tolist()
    assert got[:5] == [0, 0xE3069283, 0x8A9136AA, 0x62A8AB43, 0x46DD794E]

    def slow(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert got[5] == slow(data[5])
    assert int(records.masked(np.array([0xE3069283], np.uint32))[0]) == (((0xE3069283 >> 15) | (0xE3069283 << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def test_records_round_trip(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, "x") for r in docs.collect()] + [(900, None, "x"), (901, "", "x"), (None, "no id é", "x"), (902, "twice", "x"), (902, "twice", "x"), (903, "a" * 30_000, "x")]
    path = f"file://{tmp_path}/out"
    index = records.write_records(spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(3), path).collect()
    random.Random(1).shuffle(index)
    fs, root = pafs.FileSystem.from_uri(path)
    enc = Tokens(spark).encoding()
    got = []
    for r in index:
        with fs.open_input_file(f"{root}/data/{r.shard}") as f:
            f.seek(r.offset)
            raw = f.read(r.length)
        i, ids = records.read_record(raw)
        assert (i == records.NO_ID) if r.doc_id is None else i == r.doc_id
        assert len(ids) == r.n_tokens
        got.append((r.doc_id, enc.decode(ids.tolist())))
    key = lambda x: (str(x[0]), x[1])
    assert sorted(got, key=key) == sorted([(i, t) for i, t, _ in rows if t is not None], key=key)
    spoilt = bytearray(raw)
    spoilt[-6 if len(raw) > 28 else 20] ^= 1
    with pytest.raises(ValueError):
        records.read_record(bytes(spoilt))
    with pytest.raises(ValueError):
        records.read_record(raw[:-1])
    names = {x.base_name for x in fs.get_file_info(pafs.FileSelector(f"{root}/data"))}
    assert names == {r.shard for r in index}
    assert records.write_records(docs.limit(0)).collect() == []


# -- media --


def frame(index=9, rate=0, protected=False, mono=False, fill=b"\x55", version=3, layer=1):
    h = 0xFFE00000 | version << 19 | layer << 17 | (0 if protected else 1 << 16) | index << 12 | rate << 10 | (3 << 6 if mono else 0)
    info = media.header(h)
    body = (fill * info[0])[: info[0] - 4 - (2 if protected else 0)]
    head = struct.pack(">I", h)
    if protected:
        side = media.side_bytes(version, info[6])
        c = 0xFFFF
        for b in head[2:] + body[:side]:
            c ^= b << 8
            for _ in range(8):
                c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        head += struct.pack(">H", c)
    return head + body


def parsed(data):
    return dict(zip(media._NAMES, media.media_rows([data])[0]))


def test_plain_stream():
    f = frame()
    assert len(f) == 417
    p = parsed(f * 100)
    assert p["valid"] and p["n_frames"] == 100 and p["n_samples"] == 115_200 and p["duration_s"] == 115_200 / 44_100
    assert p["frame_offsets"] == [417 * k for k in range(100)] and p["mean_kbps"] == 128 and p["n_skipped"] == 0 and (p["layer"], p["version"]) == (3, 1.0)


def test_versions_and_layers():
    for version, layer, samples, hz in ((3, 3, 384, 44100), (3, 2, 1152, 44100), (2, 1, 576, 22050), (0, 1, 576, 11025)):
        p = parsed(frame(index=5, version=version, layer=layer) * 7)
        assert p["n_frames"] == 7 and p["n_samples"] == 7 * samples and p["sample_rate"] == hz and p["layer"] == 4 - layer


def test_tags_and_tables():
    title = b"\x03" + "Lied é".encode()
    body = b"TIT2" + struct.pack(">I", len(title)) + b"\0\0" + title + b"TPE1" + struct.pack(">I", 3) + b"\0\0\x00Al"
    id3 = b"ID3\x03\0\0" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body
    xing = bytearray(frame())
    xing[4 + 32 : 4 + 32 + 16] = b"Xing" + struct.pack(">III", 3, 9, 4000)
    frames = [frame(index=i) for i in (9, 11, 5)] * 3
    p = parsed(id3 + bytes(xing) + b"".join(frames) + b"TAG" + b"Old".ljust(125, b"\0"))
    assert (p["title"], p["artist"], p["vbr"], p["vbr_frames"], p["vbr_bytes"], p["n_frames"]) == ("Lied é", "Al", "Xing", 9, 4000, 9)
    assert p["frame_offsets"][0] == len(id3) + 417 and p["n_skipped"] == 0 and p["duration_s"] == 9 * 1152 / 44100
    vbri = bytearray(frame())
    vbri[36:54] = b"VBRI" + bytes(6) + struct.pack(">II", 5000, 4)
    assert (parsed(bytes(vbri) + frame() * 4)["vbr"], parsed(bytes(vbri) + frame() * 4)["vbr_frames"]) == ("VBRI", 4)
    old = parsed(frame() * 3 + b"TAG" + b"Old song".ljust(30, b"\0") + b"Who".ljust(95, b" "))
    assert (old["title"], old["artist"]) == ("Old song", "Who")


def test_damage():
    f = frame(protected=True)
    bad = bytearray(f)
    bad[10] ^= 4
    p = parsed(f * 3 + bytes(bad) + f * 2)
    assert (p["n_checked"], p["n_bad_crc"], p["n_frames"]) == (6, 1, 6)
    p = parsed(b"noise\xff\xfb\x90" + f * 4 + b"\xff\xff junk \xff\xfb" + f * 4 + f[:100])
    assert p["n_frames"] == 8 and p["n_resyncs"] == 2 and p["n_bad_crc"] == 0
    assert p["n_skipped"] == 8 + 10 + 100 and p["frame_offsets"][4] == 8 + 4 * 417 + 10
    for data in (None, b"", b"\xff", b"\xff\xfb", b"text only", bytes(1000), b"\xff" * 1000, b"ID3", b"TAG" * 60):
        p = parsed(data)
        assert not p["valid"] and p["duration_s"] == 0 and p["frame_offsets"] == []


def crc_bits(bits):
    """CRC-16 with polynomial x^16 + x^15 + x^2 + 1 from all ones, a bit at a time as the standard's diagram has it."""
    reg = [1] * 16  # most significant first
    for b in bits:
        back = reg[0] ^ b
        reg = reg[1:] + [back]
        reg[0], reg[13] = reg[0] ^ back, reg[13] ^ back
    return int("".join(map(str, reg)), 2)


def allocation(layer, version, hz, kbps, channels, mode, extension, body):
    """Bits that the checksum covers after the header, by the standard's text."""
    bits = "".join(f"{b:08b}" for b in body)
    bound = {0: 4, 1: 8, 2: 12, 3: 16}[extension] if mode == 1 else 32
    if layer == 1:
        return bits[: sum(4 * (channels if sb < bound else 1) for sb in range(32))]
    if version == 2:
        widths = "4444" + "3" * 7 + "2" * 19
    elif kbps // channels in (32, 48):
        widths = "44" + "3" * (10 if hz == 32000 else 6)
    elif hz == 48000 or kbps // channels in (56, 64, 80):
        widths = "4" * 11 + "3" * 12 + "2" * 4
    else:
        widths = "4" * 11 + "3" * 12 + "2" * 7
    at = selected = 0
    for sb, w in enumerate(map(int, widths)):
        for _ in range(channels if sb < bound else 1):
            if "1" in bits[at : at + w]:
                selected += channels if sb >= bound else 1
            at += w
    return bits[: at + 2 * selected]


def test_checksums_of_layers_one_and_two():
    rng = random.Random(9)
    kbps_of = {(1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
    rates = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000)}
    seen = set()
    for _ in range(300):
        layer, version, rate, index, mode, extension = rng.choice((1, 2)), rng.choice((1, 2)), rng.randrange(3), rng.randrange(6, 15), rng.randrange(4), rng.randrange(4)
        h = 0xFFE00000 | (3 if version == 1 else 2) << 19 | (4 - layer) << 17 | index << 12 | rate << 10 | mode << 6 | extension << 4
        kbps, hz, channels = kbps_of[layer, version][index], rates[version][rate], 1 if mode == 3 else 2
        size = 12000 * kbps // hz * 4 if layer == 1 else 144000 * kbps // hz
        body = bytes(rng.randrange(256) & rng.randrange(256) for _ in range(size - 6))
        if 0xFF in body:
            body = body.replace(b"\xff", b"\x7f")
        head = struct.pack(">I", h)
        covered = allocation(layer, version, hz, kbps, channels, mode, extension, body)
        crc = crc_bits([int(b) for x in head[2:] for b in f"{x:08b}"] + [int(b) for b in covered])
        whole = head + struct.pack(">H", crc) + body
        spoilt = bytearray(whole)
        k = rng.randrange(len(covered))
        spoilt[6 + k // 8] ^= 128 >> k % 8
        p = parsed(whole * 2 + bytes(spoilt) + whole)
        assert (p["n_frames"], p["n_checked"], p["n_bad_crc"], p["layer"]) == (4, 4, 1, layer)
        seen.add((layer, version, mode))
    assert len(seen) == 16


def test_seek_tables_and_gapless():
    xing = bytearray(frame())
    at = 4 + 32
    toc = bytes(range(100))
    tag = b"Xing" + struct.pack(">III", 15, 50, 20000) + toc + struct.pack(">I", 7) + b"LAME3.99r" + bytes(12) + bytes([576 >> 4, (576 & 15) << 4 | 1000 >> 8, 1000 & 255])
    xing[at : at + len(tag)] = tag
    p = parsed(bytes(xing) + frame() * 50)
    assert (p["encoder_delay"], p["encoder_padding"], p["n_samples"]) == (576, 1000, 50 * 1152) and p["duration_s"] == (50 * 1152 - 1576) / 44100
    assert p["seek_table"] == [k * 20000 // 256 for k in range(100)]
    vbri = bytearray(frame())
    vbri[36:72] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 200, 75, 5000, 4, 5, 10, 2, 1) + struct.pack(">5H", 3, 4, 5, 6, 7)
    p = parsed(bytes(vbri) + frame() * 4)
    assert p["seek_table"] == [0, 30, 70, 120, 180] and p["encoder_delay"] == 200 and p["duration_s"] == (4 * 1152 - 200) / 44100
    inner = b"TIT2" + struct.pack(">I", 3) + b"\0\0\x00\xff\xe0"
    safe = inner.replace(b"\xff", b"\xff\x00")
    assert parsed(b"ID3\x03\0\x80" + bytes([0, 0, 0, len(safe)]) + safe + frame() * 3)["title"] == "\xff\xe0"


def test_random_bytes_never_fail():
    rng = np.random.default_rng(5)
    for k in range(150):
        data = rng.integers(0, 256, rng.integers(0, 3000)).astype(np.uint8)
        data[rng.random(len(data)) < 0.2] = 255
        media.parse((b"ID3" if k % 3 == 0 else b"") + data.tobytes())


def test_document_streams(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    got = {r.doc_id: r for r in media.document_streams(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        raw, out = media.stream_of(r.doc_id, r.text, r.source), got[r.doc_id]
        heads = [media.header(int.from_bytes(raw[o : o + 4], "big")) for o in out.frame_offsets]
        carried = b"".join(raw[o + 4 + (2 if r.doc_id % 2 == 0 else 0) : o + h[0]] for o, h in zip(out.frame_offsets, heads))
        assert carried.rstrip(b"\0").decode() == r.text and out.n_frames == len(heads)
        silent = 576 + min(4095, heads[-1][0]) if r.doc_id % 3 == 0 else 0  # what the made streams' tags say
        assert out.duration_s == max(0, out.n_samples - silent) / out.sample_rate and out.encoder_delay == (576 if silent else 0)
        if r.doc_id % 3 == 0:
            assert out.vbr == "Xing" and out.vbr_frames == out.n_frames
        assert out.n_bad_crc == (1 if r.doc_id % 22 == 0 and out.n_frames > 1 else 0)
    table = spark.createDataFrame([(1, bytearray(frame() * 3)), (2, None), (None, bytearray(b"x")), (1, bytearray(frame() * 3))], "k long, audio binary")
    out = media.media_info(table, "k").collect()
    assert sorted((str(r.k), r.n_frames) for r in out) == [("1", 3), ("1", 3), ("2", 0), ("None", 0)]
    assert media.media_info(table.limit(0), "k").collect() == []


def test_tokens_of_long_runs(spark):
    of = Tokens(spark)
    plain, mine = of.encoding().encode_ordinary, of.encoder()
    for gap in (" ", "\n", "　", "\r\n \t"):
        run = gap * (20_000 // len(gap))
        for text in (run, "a" + run, run + "b", f"x{run}y z {run} 1{run}", f"a{run}\x1cb", f"{run}!"):
            assert mine(text) == plain(text)
    long = "\n" * 3_000_000 + " " * 2_000_000
    docs = spark.createDataFrame([(1, long), (2, "w" + long + "w"), (3, "short")], "doc_id long, text string")
    packed = packing.pack(docs).groupBy("doc_id").agg({"n_tokens": "sum"}).collect()
    index = records.write_records(docs).collect()
    assert {r[0]: r[1] for r in packed} == {r.doc_id: r.n_tokens for r in index} and len(index) == 3
