"""Model slots: anything with these call signatures plugs in; the defaults are deterministic and need no model."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import ANSWER_STOPWORDS, sigmoid


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class NliScorer(Protocol):
    def __call__(self, pairs: list[tuple[str, str]]) -> list[tuple[str, float]]: ...


class Generator(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


_STOP = frozenset(ANSWER_STOPWORDS)


def _words(text: str | None) -> list[str]:
    return [w for w in re.findall(r"\w+", (text or "").lower()) if w not in _STOP]


def hashed_embedding(texts: list[str], dimensions: int = 64) -> np.ndarray:
    """A signed hash of the words, of unit length (ML1)."""
    out = np.zeros((len(texts), dimensions))
    for row, text in zip(out, texts):
        for word in _words(text):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            row[h % dimensions] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1.0, norm)


def overlap_score(pairs: list[tuple[str, str]]) -> list[float]:
    """A raw score between -4 and 4 from the share of the query's words in the text; it is not calibrated (ML2)."""
    out = []
    for query, text in pairs:
        q = set(_words(query))
        out.append(8.0 * len(q & set(_words(text))) / len(q) - 4.0 if q else -4.0)
    return out


def overlap_nli(pairs: list[tuple[str, str]]) -> list[tuple[str, float]]:
    """entailment where most words are shared, contradiction where only one side negates, else neutral (ML3)."""
    out = []
    for claim, text in pairs:
        a, b = _words(claim), _words(text)
        share = len(set(a) & set(b)) / len(set(a)) if a else 0.0
        differs = ("not" in a) != ("not" in b)
        out.append(("contradiction", share) if share >= 0.5 and differs else ("entailment", share) if share >= 0.5 else ("neutral", 1 - share))
    return out


def echo(prompts: list[str]) -> list[str]:
    """A generator for tests: it answers A, or repeats the prompt's last line."""
    return ["Answer: A" if "Options:" in p else p.strip().split("\n")[-1] for p in prompts]


# What the mock expansion adds for a keyword.
PASSAGES = (("protein", "Protein requirements are given in g/kg/day and rise with prematurity."), ("lipid", "Lipid emulsions are started early and advanced with triglyceride monitoring."), ("glucose", "The glucose infusion rate is titrated in mg/kg/min to keep normal glucose."))


def hyde(queries: list[str]) -> list[str]:
    """The query led by a passage that its keywords suggest; without one the query alone (ML4)."""
    return [" ".join([*(p for k, p in PASSAGES if k in q.lower()), q]) for q in queries]


def paraphrases(query: str, most: int = 3) -> list[str]:
    """The query and fixed rewordings (ML5)."""
    return [query, f"What is known about {query.rstrip('?')}?", f"Guidelines and recommendations: {query}"][:most]


def batched(fn: Callable[[list], list], size: int = 32) -> Callable[[list], list]:
    """fn over runs of at most size items."""
    return lambda items: [x for at in range(0, len(items), size) for x in fn(items[at : at + size])]


def embedded(text: str, model: Embedder = hashed_embedding, size: int = 32) -> Column:
    """Vectors of a text column; the model is loaded once per worker by its own first call (ML1)."""

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            rows = texts.fillna("").tolist()
            yield pd.Series([list(map(float, v)) for at in range(0, len(rows), size) for v in model(rows[at : at + size])])

    return embed(F.col(text))


def pair_scored(query: str, text: str, model: PairScorer = overlap_score) -> Column:
    """The squashed score of query and text (ML2, M11)."""

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(batched(model)(list(zip(q.fillna(""), t.fillna("")))), dtype="float64")

    return sigmoid(score(F.col(query), F.col(text)))


def nli_blended(heuristic: Column, claim: str, text: str, model: NliScorer = overlap_nli) -> Column:
    """Half the heuristic score and half the entailment; a contradiction gives 0 (ML3)."""

    @F.pandas_udf("label string, confidence double")
    def verify(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(batched(model)(list(zip(a.fillna(""), b.fillna("")))), columns=["label", "confidence"])

    v = verify(F.col(claim), F.col(text))
    return F.when(v["label"] == "contradiction", 0.0).otherwise(0.5 * heuristic + F.when(v["label"] == "entailment", 0.5 * v["confidence"]).otherwise(0.0))


def expanded(queries: DataFrame, query: str = "text", expand: Callable[[str], list[str]] = paraphrases) -> DataFrame:
    """A row per wording of each query, with its place among them (ML5)."""

    @F.pandas_udf("array<string>")
    def every(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: expand(t or ""))

    return queries.select("*", F.posexplode(every(F.col(query))).alias("variant", "variant_text"))


@dataclass(frozen=True)
class Reply:
    """An answer, the tokens that it took, how long the call was, and what went wrong."""

    text: str
    tokens: int
    latency_ms: float
    error: str | None


def called(model: Generator, prompts: list[str]) -> list[Reply]:
    """The replies to prompts. A model answers with texts, or with pairs of text and tokens; a call of several that fails is
    made again for each alone, so that what fails is a reply with its error, and the others have theirs. The latency of a
    reply is that of its call."""
    if not prompts:
        return []
    began = time.perf_counter()
    try:
        answers = [a if isinstance(a, tuple) else (a, 0) for a in model(prompts)]
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
        took = (time.perf_counter() - began) * 1000
        return [Reply(text or "", int(tokens or 0), took, None) for text, tokens in answers]
    except Exception as e:  # noqa: BLE001 - whatever a provider raises is a result of the run
        if len(prompts) > 1:
            return [reply for p in prompts for reply in called(model, [p])]
        return [Reply("", 0, (time.perf_counter() - began) * 1000, str(e) or type(e).__name__)]


def generated(rows: DataFrame, prompt: str = "prompt", model: Generator = echo, retries: int = 3, accept: Callable[[str], bool] = lambda r: bool(r)) -> DataFrame:
    """Adds response_text: the first accepted answer of at most so many tries, else the last one (ML6)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [""] * len(frame)
            todo = list(range(len(frame)))
            for _ in range(retries):
                if not todo:
                    break
                for k, answer in zip(todo, model([frame[prompt].iloc[k] for k in todo])):
                    answers[k] = answer
                todo = [k for k in todo if not accept(answers[k])]
            yield frame.assign(response_text=answers)

    kept = [f for f in rows.schema.fields if f.name != "response_text"]
    return rows.drop("response_text").mapInPandas(run, T.StructType([*kept, T.StructField("response_text", T.StringType())]))
