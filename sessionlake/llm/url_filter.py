"""URL filters: longest host-and-path rule first, then a weighted vocabulary counted with Aho-Corasick.

A term counts where no letter or digit stands beside it. A url is rejected on one strict term, or where the weights of
the distinct soft terms found reach the vocabulary's limit. The vocabulary may come from a table of up to ``MOST_TERMS``
terms (more are an error, never left out), which is sent to the tasks as it is.

``judge_urls`` keeps all columns of its input and adds ``host, path, rule, verdict, n_strict, n_soft, terms, score``.
Input columns of those names are replaced. Null urls and urls without ``://`` have an empty host and path, match no rule
and are judged by their terms (null: allow). Very long urls are searched whole. An empty table gives an empty table; repeated
rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Verdict, host and path of each rule; a rule fits its host and all subdomains where the path starts with its own.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Fixed vocabulary: a strict term rejects alone, soft terms reject together.
STRICT = ("porn", "xxx", "casino", "viagra", "malware", "phishing", "warez", "spam-farm")
SOFT = ("adult", "bet", "bonus", "cheap", "click", "crack", "deal", "free", "pills", "poker", "promo", "sexy", "spam", "win")


MOST_TERMS = 200_000


@dataclass(frozen=True)
class Vocabulary:
    """Strict terms, and soft ones, which weigh 1 each unless ``weights`` says otherwise; terms are lower-case."""

    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    limit: float = 2
    weights: dict[str, float] = field(default_factory=dict, compare=False)

    @classmethod
    def from_table(cls, terms: DataFrame, limit: float = 2) -> "Vocabulary":
        """From rows ``term, kind, weight`` (kind ``strict`` or ``soft``; a null weight is 1). Null and empty terms go."""
        rows = terms.where("length(term) > 0").selectExpr("lower(term) as term", "kind", "coalesce(weight, 1D) as weight")
        told = rows.groupBy("term").agg(F.max(F.col("kind") == "strict").alias("strict"), F.max("weight").alias("weight")).limit(MOST_TERMS + 1).collect()
        if len(told) > MOST_TERMS:
            raise ValueError(f"more than {MOST_TERMS} terms")
        strict, soft = (tuple(sorted(r["term"] for r in told if r["strict"] == k)) for k in (True, False))
        return cls(strict, soft, limit, {r["term"]: r["weight"] for r in told if not r["strict"]})

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for kind, terms in ((0, self.soft), (1, self.strict)):
            for term in terms:
                found.add_word(term, (kind, term))
        if len(found):
            found.make_automaton()
        return found

    def score(self, strict: set[str], soft: set[str]) -> float:
        """Weights found by ``limit``: 1 or more rejects."""
        return (self.limit * len(strict) + sum(self.weights.get(t, 1.0) for t in soft)) / self.limit


def term_hits(automaton, url: str) -> tuple[set[str], set[str]]:
    """Distinct soft and strict terms of the url that are not inside a longer run of letters and digits."""
    hits: tuple[set[str], set[str]] = (set(), set())
    last = len(url) - 1
    for end, (kind, term) in automaton.iter(url) if len(automaton) else ():
        begin = end - len(term)
        if (begin < 0 or not url[begin].isalnum()) and (end == last or not url[end + 1].isalnum()):
            hits[kind].add(term)
    return hits


def _host_and_path(url):
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1))
    after = F.substring_index(after, "?", 1)
    host = F.substring_index(after, "/", 1)
    path = F.substr(after, F.length(host) + 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules=RULES, vocabulary: Vocabulary = Vocabulary(), url: str = "url") -> DataFrame:
    made = ("host", "path", "rule", "verdict", "n_strict", "n_soft", "terms", "score", "_ruled")
    pages = pages.drop(*(c for c in made if c != url))
    host, path = _host_and_path(F.col(f"`{url}`").cast("string"))
    out = pages.withColumns({"host": host, "path": path})
    rule = verdict = F.lit(None).cast("string")
    for what, on_host, on_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # longer ones are asked first
        fits = ((F.col("host") == on_host) | F.endswith("host", F.lit(f".{on_host}"))) & F.startswith("path", F.lit(on_path))
        rule = F.when(fits, F.lit(on_host + on_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    out = out.withColumns({"rule": rule, "_ruled": verdict})
    plain = [c for c in out.columns if c != "_ruled"]
    schema = T.StructType(
        [out.schema[c] for c in plain]
        + [T.StructField("verdict", T.StringType()), T.StructField("n_strict", T.LongType())]
        + [T.StructField("n_soft", T.LongType()), T.StructField("terms", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    at = plain.index(url)

    def count_terms(batches):
        automaton = vocabulary.automaton()
        for batch in batches:
            verdicts, strict, soft, terms, scores = [], [], [], [], []
            for text, ruled in zip(batch.column(at).to_pylist(), batch.column(len(plain)).to_pylist()):
                s, k = term_hits(automaton, str(text).lower()) if text is not None else (set(), set())
                score = vocabulary.score(k, s)
                verdicts.append(ruled or ("block" if score >= 1 else "allow"))
                strict.append(len(k))
                soft.append(len(s))
                terms.append(",".join(sorted(s | k)))
                scores.append(min(1.0, score))
            new = [pa.array(verdicts, pa.string()), pa.array(strict, pa.int64()), pa.array(soft, pa.int64())]
            new += [pa.array(terms, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(plain)], *new], [*plain, *schema.names[len(plain):]])

    return out.select(*(f"`{c}`" for c in plain), "_ruled").mapInArrow(count_terms, schema)
