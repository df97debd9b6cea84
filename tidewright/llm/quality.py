"""Weak supervision of document quality: rules vote or abstain, expectation-maximisation weighs them.

Counts are exact over whole texts. Each rule votes good (+1), bad (-1) or abstains (0). A document's votes form one
of at most 3**rules patterns, so a count of documents by pattern is all that the estimation needs; its size does not
depend on the data.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import _SPACE, cut, map_texts, prefix_hash, mix, span_hash, window_hashes

_CLASSES = {"symbols": b"#*$%&|<>", "upper": bytes(range(65, 91)), "letters": bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]), "loud": b"!", "digits": b"0123456789"}
_MEMBER = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_letters", "n_loud", "n_digits"]

#: Rules that see one defect: (rule, value, side, bound). A value beyond the bound votes bad; else the rule abstains,
#: since the absence of one defect says nothing about the others.
DEFECTS = [
    ("symbols", lambda c: c["n_symbols"] / c["n_words"], ">", 0.15),
    ("capitals", lambda c: c["n_upper"] / F.greatest(c["n_letters"], F.lit(1)), ">", 0.6),
    ("shouting", lambda c: c["n_loud"] / c["n_words"], ">", 0.4),
    ("repeats", lambda c: c["n_repeat_words"] / c["n_words"], ">", 0.45),
    ("duplicate_lines", lambda c: F.when(c["n_lines"] >= 4, c["n_dup_lines"] / c["n_lines"]), ">", 0.6),
    ("vocabulary", lambda c: F.when(c["n_words"] >= 40, c["n_distinct_words"] / F.pow(c["n_words"].cast("double"), 0.85)), "<", 0.35),
    ("word_length", lambda c: c["word_chars"] / c["n_words"], ">", 14.0),
]
#: The rule that can speak for a document: it votes good where every one of these values is that of plain prose.
PROSE = [
    (lambda c: c["n_symbols"] / c["n_words"], 0.0, 0.05),
    (lambda c: c["n_upper"] / F.greatest(c["n_letters"], F.lit(1)), 0.0, 0.3),
    (lambda c: c["n_loud"] / c["n_words"], 0.0, 0.15),
    (lambda c: c["n_repeat_words"] / c["n_words"], 0.0, 0.42),
    (lambda c: c["word_chars"] / c["n_words"], 2.5, 10.0),
]
N_RULES = len(DEFECTS) + 1


def count_texts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """COUNTS of whole texts; null and empty texts count nothing."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))
    starts = ends - np.diff(ends, prepend=0)
    space, n = _SPACE[data], len(raw)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[ends] - total[starts]

    prefix = prefix_hash(data)
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))
    a, b = edge[::2], edge[1::2]
    words, doc = span_hash(prefix, a, b), np.searchsorted(ends, a, side="right")
    own = lambda h, d: mix(h + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.unique(own(words, doc), return_index=True)[1]
    windows, at = window_hashes(words, doc, 3)
    _, which, times = np.unique(own(windows, doc[at]), return_inverse=True, return_counts=True)
    twice = at[times[which] > 1]
    repeated = np.zeros(len(words), bool)
    for k in range(3):
        repeated[twice + k] = True
    stop = np.flatnonzero(data == 10)
    begin = np.concatenate([[0], stop[:-1] + 1])
    seen = np.concatenate([[0], np.cumsum(~space, dtype=np.int64)])
    full = seen[stop] > seen[begin]
    begin, stop = begin[full], stop[full]
    line_doc = np.searchsorted(ends, begin, side="right")
    first = np.unique(own(span_hash(prefix, begin, stop), line_doc), return_index=True)[1]
    per = lambda d: np.bincount(d, minlength=n).astype(np.int64)
    return {
        "n_words": per(doc),
        "word_chars": per_doc(~space & ((data & 0xC0) != 0x80)),
        "n_symbols": per_doc(_MEMBER["symbols"][data]),
        "n_dup_lines": per(line_doc) - per(line_doc[first]),
        "n_repeat_words": per(doc[repeated]),
        "n_lines": per(line_doc),
        "n_distinct_words": per(doc[distinct]),
        "n_upper": per_doc(_MEMBER["upper"][data]),
        "n_letters": per_doc(_MEMBER["letters"][data]),
        "n_loud": per_doc(_MEMBER["loud"][data]),
        "n_digits": per_doc(_MEMBER["digits"][data]),
    }


def vote(counts: DataFrame) -> DataFrame:
    """Adds ``votes``, the pattern as a number in base three (digit: vote + 1), the prose rule's digit last."""
    c = {k: F.col(k) for k in COUNTS} | {"n_words": F.greatest(F.col("n_words"), F.lit(1))}
    pattern = F.lit(0)
    for _, value, side, bound in DEFECTS:
        v = value(c)
        pattern = pattern * 3 + F.when(v > bound if side == ">" else v < bound, 0).otherwise(1)
    prose = F.col("n_words") > 0
    for value, low, high in PROSE:
        prose = prose & value(c).between(low, high)
    return counts.withColumn("votes", (pattern * 3 + F.when(prose, 2).otherwise(1)).cast("int"))


def estimate(patterns: np.ndarray, n: np.ndarray, rules: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: (posterior of good by pattern, P(vote | class) of each rule, prior).

    It starts from "bad if any rule says bad". Rules count as independent given the class; one vote is added to each
    cell, so that no probability is zero.
    """
    digits = (patterns[:, None] // 3 ** np.arange(rules - 1, -1, -1)) % 3
    good = np.where((digits == 0).any(axis=1), 0.05, np.where((digits == 2).any(axis=1), 0.95, 0.8))
    seen = np.eye(3)[digits]  # pattern, rule, vote
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good])
        table = np.einsum("cp,prv->crv", weight, seen) + 1.0
        table /= table.sum(axis=2, keepdims=True)
        prior = float((weight[1].sum() + 1) / (n.sum() + 2))
        ll = np.einsum("prv,crv->cp", seen, np.log(table)) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -700, 700)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return good, table, prior


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row a document: COUNTS, base_failed, posterior (probability of good quality) and kept.

    A document fails the base if it has under 50 words, or more than half of its words in repeated windows; it is
    kept if it passes and its posterior is at least the threshold. Null text: no words. Empty table: no rows.
    Repeated rows are judged each for itself.
    """
    schema = ", ".join(f"{k} bigint" for k in COUNTS)
    counted = cut(vote(map_texts(docs, [id_col], text_col, lambda: count_texts, schema, limit=600_000)))
    found = counted.groupBy("votes").count().collect()  # at most 3**N_RULES rows
    patterns = np.array([r[0] for r in found], np.int64)
    if len(found):
        good, _, _ = estimate(patterns, np.array([r[1] for r in found], float), N_RULES)
        probability = F.create_map(*chain.from_iterable((F.lit(int(p)), F.lit(float(g))) for p, g in zip(patterns, good, strict=True)))[F.col("votes")]
    else:
        probability = F.lit(None).cast("double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("posterior", probability).withColumn("kept", ~failed & (F.col("posterior") >= threshold))
