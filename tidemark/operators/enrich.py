"""Enrichment by a language model: only the rows that qualify leave the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.functions.text import strip
from tidemark.operators.base import Operator, Watch, unwatched
from tidemark.schema import set_meta


MODEL = dict(llm_backend="ollama", llm_model=None, max_tokens=2048, temperature=0.3)


class Enricher(Operator):
    """Asks a model about qualifying rows. Calls may be repeated when a task is, so stages write their result once."""

    styles: dict[str, str] = {}
    style = default_style = ""

    def prompt(self) -> Column:
        """The style's template with its placeholders filled in, as a Column."""
        template = self.styles.get(self.style, self.styles[self.default_style])
        given = F.when(F.col("input") == "", "").otherwise(F.concat(F.lit("\nInput: "), "input"))
        values = {"instruction": F.col("instruction"), "output": F.col("output"), "input_text": given}
        parts: list[Column] = []
        while template:
            at, name = min(((template.find("{" + k + "}"), k) for k in values if "{" + k + "}" in template), default=(len(template), ""))
            if at:
                parts.append(F.lit(template[:at]))
            if name:
                parts.append(values[name])
            template = template[at + len(name) + 2 :] if name else ""
        return F.concat(*parts)

    def asked(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_text`` and ``_error`` of the model's answer to ``_prompt``; a null prompt isn't asked."""
        params = dict(backend=self.llm_backend, model=self.llm_model, max_tokens=self.max_tokens, temperature=self.temperature)
        params |= {k: v for k, v in self.extra.items() if k in ("base_url", "api_key", "fallback", "fallback_params")}

        @F.pandas_udf("struct<text string, error string>")
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            from tidemark.backends.llms import get_llm

            llm = get_llm(**params)  # made in the worker: clients don't travel
            for s in batches:
                rows = []
                for p in s:
                    try:
                        rows.append((llm.generate(p).text.strip(), None) if p is not None else (None, None))
                    except Exception as e:
                        rows.append((None, str(e) or type(e).__name__))
                yield pd.DataFrame(rows, columns=["text", "error"])

        answer = ask.asNondeterministic()("_prompt")
        return df.withColumn("_answer", answer).withColumns({"_text": F.col("_answer.text"), "_error": F.col("_answer.error")})


class LLMSynthesis(Enricher):
    """Rewrites the outputs of poor samples by a model; a failed call leaves the sample with a note."""

    name, default_style = "llm_synthesis", "enhance"
    styles = {
        "textbook": "Turn this answer into a clear textbook passage with definitions and an example.\nQuestion: {instruction}\nAnswer: {output}",
        "enhance": "Improve this answer: correct it, complete it and keep its meaning.\nQuestion: {instruction}\nAnswer: {output}",
        "expand": "Give this answer more depth, with reasons and context.\nQuestion: {instruction}\nAnswer: {output}",
    }

    defaults = MODEL | dict(synthesis_style="textbook", quality_threshold=0.7, target_samples="low_quality")

    def prepare(self) -> None:
        self.style, self.target, self.threshold = self.synthesis_style, self.target_samples, self.quality_threshold

    def wanted(self) -> Column:
        return scores.should_synthesize(self.target, F.col("meta.quality_score"), F.col("meta.knowledge_score"), self.threshold)

    def apply(self, df: DataFrame, watch: Watch = unwatched) -> DataFrame:
        cols = df.columns
        df = watch(df, "in")
        rest = df.filter(~self.wanted())
        done = self.asked(df.filter(self.wanted()).withColumn("_prompt", self.prompt()))
        ok = F.col("_error").isNull()
        done = set_meta(
            done, synthesized=F.when(ok, True).otherwise(F.col("meta.synthesized")), synthesis_style=F.when(ok, self.style).otherwise(F.col("meta.synthesis_style")),
            original_output=F.when(ok, F.col("output")).otherwise(F.col("meta.original_output")), synthesis_error=F.when(~ok, F.col("_error")).otherwise(F.col("meta.synthesis_error")),
        ).withColumn("output", F.when(ok, strip(F.col("_text"))).otherwise(F.col("output")))
        done = watch(done, "done", synthesized_count=F.count_if(ok))
        return watch(rest.unionByName(done.select(*cols)), "out")

    @property
    def metrics(self) -> dict:
        super().metrics
        if self._out is None:
            return {}
        n, m = self._seen["in"].get["count"], self._seen["done"].get["synthesized_count"]
        return {"input_count": n, "output_count": n, "synthesized_count": m, "synthesis_rate": m / n if n else 0.0}


class ReasoningChainEnhancer(Enricher):
    """Has a model answer reasoning samples step by step; an answer that loses the numbers is refused."""

    name, default_style = "reasoning_chain", "step_by_step"
    styles = {
        "step_by_step": "Solve this in numbered steps and end with the answer.\nTask: {instruction}{input_text}",
        "cot": "Think aloud about this before you answer it.\nTask: {instruction}{input_text}",
        "tree_of_thought": "Consider several ways to solve this, compare them, and follow the best.\nTask: {instruction}{input_text}",
    }

    defaults = MODEL | dict(chain_style="step_by_step", verify_logic=True, target_category="reasoning")

    def prepare(self) -> None:
        self.style, self.target, self.verify = self.chain_style, self.target_category, self.verify_logic

    def wanted(self) -> Column:
        return scores.should_enhance(F.col("category"), F.col("output"), F.col("meta.has_reasoning_chain"), self.target)

    def apply(self, df: DataFrame, watch: Watch = unwatched) -> DataFrame:
        cols = df.columns
        df = watch(df, "in")
        rest = df.filter(~self.wanted())
        done = self.asked(df.filter(self.wanted()).withColumn("_prompt", self.prompt()))
        asked = F.col("_error").isNull()
        right = asked & (scores.keeps_numbers(F.col("output"), F.col("_text")) if self.verify else F.lit(True))
        done = done.withColumn("_ok", F.coalesce(right, F.lit(False)))
        ok = F.col("_ok")
        done = set_meta(
            done, has_reasoning_chain=F.when(ok, True).otherwise(F.col("meta.has_reasoning_chain")), chain_style=F.when(ok, self.style).otherwise(F.col("meta.chain_style")),
            original_output=F.when(ok, F.col("output")).otherwise(F.col("meta.original_output")),
            reasoning_verification_failed=F.when(asked & ~ok, True).otherwise(F.col("meta.reasoning_verification_failed")), reasoning_error=F.when(~asked, F.col("_error")).otherwise(F.col("meta.reasoning_error")),
        ).withColumn("output", F.when(ok, strip(F.col("_text"))).otherwise(F.col("output")))
        done = watch(done, "done", enhanced_count=F.count_if(ok))
        return watch(rest.unionByName(done.select(*cols)), "out")

    @property
    def metrics(self) -> dict:
        super().metrics
        if self._out is None:
            return {}
        n, m = self._seen["in"].get["count"], self._seen["done"].get["enhanced_count"]
        return {"input_count": n, "output_count": n, "enhanced_count": m, "enhancement_rate": m / n if n else 0.0}
