"""Wrapper inference on pages made from known templates."""

import random

import pytest

from tidemark.llm import wrappers
from tidemark.llm import wrappers as W


def page(rng, n, optional, unclosed=False, host="h"):
    items = [f"item {rng.random()}" for _ in range(n)]
    ps = [f"Paragraph {rng.random()} &amp; more" for _ in range(rng.randrange(1, 5))]
    end = "" if unclosed else "</p>"
    parts = {
        "title": f"T{rng.random()}", "items": items, "note": f"note {rng.random()}" if optional else None, "ps": [p.replace("&amp;", "&") for p in ps],
    }
    html = (
        f"<!DOCTYPE html><html><head><title>{parts['title']}</title><script>var x='<p>no</p>';</script></head><body><!-- c --><div class='menu'>Home</div><ul>"
        + "".join(f"<li><a href='/{i}'>{x}</a></li>" for i, x in enumerate(items)) + "</ul>"
        + (f"<aside>{parts['note']}</aside>" if optional else "") + "<article>" + "".join(f"<p>{p}{end}" for p in ps) + f"</article><footer>Fixed {host}</footer></body></html>"
    )
    return html, parts


def infer(pages):
    w = None
    for p in pages:
        n = W.nodes_of(p)
        w = W.tidy(n) if w is None else W.align(w, n)
    return W.tidy(w)


def values(fields, end):
    return [v for p, v in fields if p.endswith(end)]


@pytest.mark.parametrize("unclosed", [False, True])
def test_slots_groups_and_options(unclosed):
    rng = random.Random(1)
    made = [page(rng, rng.randrange(1, 6), k % 3 == 0, unclosed) for k in range(12)]
    w = infer([h for h, _ in made])
    kinds = [n[W.KIND] for n in w]
    assert kinds.count("r") == 2 and any(n[W.OPTION] for n in w) and not any(n[W.KIND] == "t" and n[W.VALUE].startswith("Paragraph") for n in w)
    assert {n[W.VALUE] for n in w if n[W.KIND] == "t"} == {"Home", "Fixed h"}
    for h, parts in made + [page(rng, 9, True, unclosed)]:
        f = W.extract(w, W.nodes_of(h))
        assert values(f, "title") == [parts["title"]] and values(f, "li/a") == parts["items"] and values(f, "article/p") == parts["ps"]
        assert values(f, "aside") == ([parts["note"]] if parts["note"] else [])
        assert not values(f, "footer") and not values(f, "div")


def test_order_and_merging_do_not_matter():
    rng = random.Random(2)
    pages = [page(rng, rng.randrange(1, 6), k % 2 == 0)[0] for k in range(10)]
    one = infer(pages)
    parts = [infer(pages[:4]), infer(pages[4:7]), infer(pages[7:])]
    both = W.tidy(W.align(W.align(parts[2], parts[0]), parts[1]))
    for h in pages:
        a, b = W.extract(one, W.nodes_of(h)), W.extract(both, W.nodes_of(h))
        assert a == b


def test_repeated_blocks_with_own_options():
    rows = lambda n, extra: "<table>" + "".join(f"<tr><td>{i}-{n}</td>{'<td><b>new</b></td>' if i in extra else ''}</tr>" for i in range(n)) + "</table>"
    w = infer([f"<html><body>{rows(n, e)}</body></html>" for n, e in ((3, {1}), (1, set()), (5, {0, 4}))])
    f = W.extract(w, W.nodes_of(f"<html><body>{rows(4, {2})}</body></html>"))
    assert [v for _, v in f if "-" in v] == ["0-4", "1-4", "2-4", "3-4"]


def test_broken_markup():
    for bad in ("", "plain", "<", "<<>>", "</p></div>", "<p", "<p><p><p", "<ul><li>a<li>b</ul>", "<!-- open", "<script>x", "a < b > c", "<b><i>x</b></i>", "<div " + "a='" * 50, "<td>" * 500):
        n = W.nodes_of(bad)
        opens = sum(x[W.KIND] == "o" for x in n)
        assert opens == sum(x[W.KIND] == "c" for x in n)
        W.extract(W.tidy(n), n, every=True)
        W.tidy(W.align(W.tidy(n), W.nodes_of("<p>x</p>")))
    assert [x[W.VALUE] for x in W.nodes_of("<ul><li>a<li>b</ul>") if x[W.KIND] == "t"] == ["a", "b"]
    big = "<html><body>" + "<p>word</p>" * 20_000 + "</body></html>"
    assert len(W.tidy(W.nodes_of(big))) == 5


def test_tables(spark, sf):
    rng = random.Random(3)
    made = {k: page(rng, rng.randrange(1, 6), k % 2 == 0) for k in range(20)}
    rows = [(k, f"https://User@H.example.com:8080/p/{k}?q=1", h, "c") for k, (h, _) in made.items()]
    rows += [(50, "http://one.example.org/x", page(rng, 2, True)[0], "c"), (51, None, "<p>no host</p>", "c"), (52, "http://h.example.com/", None, "c"), (53, "http://h.example.com/", "", "c"), (None, "nonsense", "x <b>y</b>", "c"), (1, rows[1][1], rows[1][2], "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string").repartition(3)
    got = W.extract_pages(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for k, (_, parts) in made.items():
        assert by[k].host == "h.example.com" and [f.value for f in by[k].fields if f.path.endswith("li/a")] == parts["items"]
        assert by[k].text == "\n".join(parts["ps"])
    assert by[52].text is None and by[53].fields == [] and "Home" in [f.value for f in by[50].fields]
    assert W.extract_pages(df.limit(0)).collect() == []
    real = spark.read.parquet(f"{sf}/pages.parquet")
    out = W.extract_pages(real).collect()
    assert len(out) == real.count() and all(r.text for r in out)
    assert not any("track(" in f.value or "margin" in f.value for r in out for f in r.fields)


def test_copies_of_one_page_are_a_lone_page(spark):
    html = "<html><body><h1>Title</h1><ul><li>a</li><li>b</li></ul><p>Some words of text.</p></body></html>"
    rows = [(1, "http://one.example/a", html)] + [(k, f"http://many.example/{k}", html) for k in range(2, 9)]
    out = {r.page_id: (r.text, r.fields) for r in W.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(out) == 8 and out[1][0] and all(v == out[1] for v in out.values())


def longest_common(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for k, b in enumerate(y, 1):
            last, row[k] = row[k], last + 1 if a == b else max(row[k], row[k - 1])
    return row[-1]


def test_matching_against_longest_common_subsequences():
    import random

    rng = random.Random(1)
    share = []
    for n in range(300):
        x = [rng.choice("abcdefghijklmnopqrst"[: rng.choice((2, 8, 20))]) for _ in range(rng.randrange(0, 40))]
        y = [c for c in x if rng.random() < 0.8] + [rng.choice("abcxyz") for _ in range(rng.randrange(0, 5))]
        found = wrappers.matching(x, y)
        assert all(x[i : i + k] == y[j : j + k] and k for i, j, k in found)
        assert all(a + k <= b and c + k <= d for (a, c, k), (b, d, _) in zip(found, found[1:]))
        best = longest_common(x, y)
        if best:
            share.append(sum(k for *_, k in found) / best)
        if x == y:
            assert found == ([(0, 0, len(x))] if x else [])
    assert sum(share) / len(share) > 0.9


def test_large_unlike_and_deep_pages():
    import random
    import time

    rng = random.Random(2)
    tags = "div p span a b i ul li table tr td h1 h2 section".split()
    page = lambda: "".join(f"<{t} class=c{rng.randrange(9)}>x{rng.randrange(99)}" + (f"</{t}>" if rng.random() < 0.9 else "") for t in rng.choices(tags, k=9500))
    a, b = page(), page()
    assert len(a) > 180_000
    began = time.perf_counter()
    w = wrappers.tidy(wrappers.align(wrappers.tidy(wrappers.nodes_of(a)), wrappers.nodes_of(b)))
    wrappers.extract(w, wrappers.nodes_of(b))
    assert time.perf_counter() - began < 20
    deep = ["<ul><li>one</li><li>" * n + f"end{n}" + "</li></ul>" * n for n in (5000, 4000)]
    w = wrappers.tidy(wrappers.align(wrappers.tidy(wrappers.nodes_of(deep[0])), wrappers.nodes_of(deep[1])))
    assert "end4000" in [v for _, v in wrappers.extract(w, wrappers.nodes_of(deep[1]))]
    began = time.perf_counter()
    wrappers.nodes_of('<a href="' * 20_000), wrappers.nodes_of("<script" * 20_000), wrappers.nodes_of("<a b='" * 20_000 + ">")
    assert time.perf_counter() - began < 2


def as_regex(wrapper):
    """A wrapper as a regular expression over a page's tags and texts, each as one line."""
    import re

    out, k = "", 0
    while k < len(wrapper):
        end = k + 1
        while wrapper[k][2] and end < len(wrapper) and wrapper[end][2] == wrapper[k][2]:
            end += 1
        part = ""
        for kind, value, _, _, body in wrapper[k:end]:
            if kind == "r":
                part += f"(?:{as_regex([n[:2] + [0] + n[3:] if i in (0, len(body[0]) - 1) else n for i, n in enumerate(body[0])])})+"
            else:
                part += "t[^\\n]*\\n" if kind == "s" else re.escape(f"{kind}{value}\n")
        out += f"(?:{part})?" if wrapper[k][2] else part
        k = end
    return out


def constants(nodes):
    for n in nodes:
        if n[0] == "t":
            yield n[1]
        elif n[0] == "r":
            yield from constants(n[4][0])


def test_every_page_matches_its_wrapper_as_a_regular_expression():
    import random
    import re

    rng = random.Random(7)
    for _ in range(60):
        labels = [f"L{k}" for k in range(5)]

        def page():
            rows = "".join(f"<li><b>{labels[0]}</b>{rng.random()}" + ("<i>new</i>" if rng.random() < 0.3 else "") + "</li>" for _ in range(rng.randrange(1, 5)))
            side = f"<aside><h2>{labels[1]}</h2><p>{rng.random()}</p></aside>" if rng.random() < 0.5 else ""
            return f"<html><body><h1>{rng.random()}</h1>{side}<ul>{rows}</ul>" + (f"<p>{rng.random()}</p>" * rng.randrange(1, 4)) + f"<footer>{labels[2]}</footer></body></html>"

        pages = [wrappers.nodes_of(page()) for _ in range(rng.randrange(2, 9))]
        w = wrappers.tidy(pages[0])
        for p in pages[1:]:
            w = wrappers.align(w, p)
        w = wrappers.tidy(w)
        rule, fixed = re.compile(as_regex(w)), set(constants(w))
        for p in pages:
            assert rule.fullmatch("".join(f"{n[0]}{n[1]}\n" for n in p))
            assert [v for _, v in wrappers.extract(w, p)] == [n[1] for n in p if n[0] == "t" and n[1] not in fixed]
