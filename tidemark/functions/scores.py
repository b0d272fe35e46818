"""Scores and predicates of a sample's texts, as Column expressions. All of them are native: no Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import begins_with_any, has_any, let, occurrences, strip, words

REFUSALS = ("sorry, but", "as an ai", "i'm not able", "i cannot", "i don't have access", "i apologize", "i can't")
QUESTIONS = ("create", "describe", "explain", "how", "list", "what", "why", "write")
DODGES = ("as an ai language model", "i can't", "i cannot", "i don't have the ability", "i'm unable")
ANSWERS = ("are", "is", "no", "the", "yes")
CHAINED = ("to solve this", "step 1", "let's break", "let me think", "first,")
ARTIFACTS = ("...", "===", ">>>", "```")

_COUNTED = {
    "factual": "什么是 介绍 几 创始 历史 发明 发现 哪个 哪里 地理 多少 定义 成立 技术 描述 是什么 科学 解释 谁是 面积 首都 人口 为什么",
    "reasoning": "为什么 优缺点 分析 区别 原因 原理 如何 怎么 怎样 方法 机制 步骤 比较 计算 过程",
    "creative": "写一 创作 创意 发挥 小说 想象 故事 构思 歌 编一 设计 诗",
    "daily": "今天 你好 再见 吃 喜欢 喝 天气 好吗 工作 心情 怎么样 感觉 最近 玩 生活 睡 谢谢",
}
_FIRST = {
    "factual": "什么是 介绍 历史 哪个 哪里 多少 是什么 谁是",
    "reasoning": "为什么 原因 如何 怎么 怎样 方法 步骤",
    "creative": "写一 创作 想象 故事 编一",
}
COUNTED = {k: tuple(v.split()) for k, v in _COUNTED.items()}
FIRST = {k: tuple(v.split()) for k, v in _FIRST.items()}
MARKS, ASKS = ("为", "在", "年", "日", "是", "月", "有"), ("为什么", "什么", "哪", "如何", "谁")


def _length_part(text: Column, least: int, most: int) -> Column:
    n = F.length(text)
    return F.when(n < least, 0.3).when(n > most, 0.5).otherwise(1.0)


def quality_score(instruction: Column, output: Column, min_instruction: int = 10, max_instruction: int = 2000, min_output: int = 20, max_output: int = 8000) -> Column:
    """Mean of five parts: both lengths, repetition, refusal and form."""
    low = F.lower(output)
    repetition = let(words(low), lambda w: F.when(F.size(w) > 10, F.least(F.lit(1.0), 1.5 * F.size(F.array_distinct(w)) / F.size(w))).otherwise(0.8))
    refusal = F.when(let(low, lambda x: has_any(x, REFUSALS)), 0.5).otherwise(1.0)
    form = F.when(instruction.contains("?") | begins_with_any(F.lower(instruction), QUESTIONS), 1.0).otherwise(0.7)
    parts = [_length_part(instruction, min_instruction, max_instruction), _length_part(output, min_output, max_output), repetition, refusal, form]
    return reduce(lambda a, b: a + b, parts) / 5


def noise_issues(instruction: Column, output: Column) -> Column:
    """The issues of a sample in the order of their rules: array of (noise_type, confidence, reason)."""
    low = F.lower(output)
    artifacts = reduce(lambda a, b: a + b, [occurrences(output, x) for x in ARTIFACTS])
    rules = [
        (F.length(strip(instruction)) < 5, "error", 0.9, "instruction_too_short"),
        (F.length(strip(output)) < 10, "error", 0.8, "output_too_short"),
        (let(words(output), lambda w: (F.size(w) > 20) & (F.size(F.array_distinct(w)) / F.size(w) < 0.3)), "error", 0.85, "highly_repetitive"),
        (instruction.contains("?") & (F.length(output) < 50) & ~has_any(low, ANSWERS), "ambiguity", 0.6, "possible_incomplete_answer"),
        (let(low, lambda x: has_any(x, DODGES)), "ambiguity", 0.5, "contains_refusal"),
        (artifacts > 10, "error", 0.6, "excessive_artifacts"),
    ]
    made = [F.when(test, F.struct(F.lit(kind).alias("noise_type"), F.lit(sure).alias("confidence"), F.lit(why).alias("reason"))) for test, kind, sure, why in rules]
    return F.array_compact(F.array(*made))


def primary_issue(issues: Column) -> Column:
    """The surest issue, the first of equals; null for none."""
    return F.when(F.size(issues) > 0, F.aggregate(issues, F.element_at(issues, 1), lambda a, x: F.when(x["confidence"] > a["confidence"], x).otherwise(a)))


def should_synthesize(target: str, quality: Column, knowledge: Column, threshold: float) -> Column:
    if target == "all":
        return F.lit(True)
    score = {"low_quality": quality, "low_knowledge": knowledge}.get(target)
    return F.lit(False) if score is None else F.coalesce(score, F.lit(1.0)) < threshold


def should_enhance(category: Column, output: Column, done: Column, target: str = "reasoning") -> Column:
    right = F.lit(True) if target == "all" else category == target
    return right & ~F.coalesce(done, F.lit(False)) & ~has_any(F.lower(output), CHAINED)


NUMBER = r"(?U)\b\d+\.?\d*\b"


def numbers(text: Column) -> Column:
    """Distinct numbers of a text, of any script's digits."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), 0))


def keeps_numbers(old: Column, new: Column) -> Column:
    """Whether at least half of the old text's distinct numbers are in the new one."""
    a = numbers(old)
    return (F.size(a) == 0) | (F.size(F.array_intersect(a, numbers(new))) / F.size(a) >= 0.5)


def category_by_count(question: Column) -> Column:
    """The category with most keywords in the question; ties go to the one listed first, none at all to daily."""
    low = F.lower(question)
    hits = {k: reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in ws]) for k, ws in COUNTED.items()}
    top = F.greatest(*hits.values())
    out = F.when(top == 0, "daily")
    for k, n in hits.items():
        out = out.when(n == top, k)
    return out


def category_by_first(question: Column) -> Column:
    """The first category of which the question has a keyword; daily for none."""
    out = None
    for k, ws in FIRST.items():
        out = F.when(has_any(question, ws), k) if out is None else out.when(has_any(question, ws), k)
    return out.otherwise("daily")


def offline_knowledge_score(instruction: Column, output: Column) -> Column:
    """Mean of length, distinct share of Chinese characters, and signs of facts. Digits are Unicode's decimal and superscript ones."""
    han = F.regexp_extract_all(output, F.lit(r"[\x{4e00}-\x{9fff}]"), 0)
    distinct = F.size(F.array_distinct(han)) / F.greatest(F.size(han), F.lit(1))
    digit = output.rlike(r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}]")
    facts = 0.5 + F.when(digit, 0.2).otherwise(0.0) + F.when(has_any(output, MARKS), 0.1).otherwise(0.0) + F.when(has_any(instruction, ASKS), 0.2).otherwise(0.0)
    return (F.least(F.lit(1.0), F.length(output) / 200) + distinct + F.least(F.lit(1.0), facts)) / 3
