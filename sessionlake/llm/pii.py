"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

DataFrame expressions only. Of each kind the matches are leftmost and do not overlap; a match that fails its check is
dropped and not tried again. Places are code points, ends exclusive: the gaps between matches (a split by the same
expression) and the matches themselves give every start. The expressions are written so that they never backtrack over
a long run: possessive repeats, and a start only where a run starts or the last match ended.

Context is read on both sides, up to the words ``NEARBY`` letters away: words that speak for a kind raise its score to
the upper value, words that speak against it take ``AGAINST`` off. Spans of added kinds (``iban``, ``secret``) below
``LEAST`` are dropped, and masking leaves every span below it as it is; the report keeps all spans of base kinds.

Null and empty texts have no spans; very long texts are searched whole. Repeated rows are judged one by one; an empty
table gives an empty table. Extra columns of any name do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "secret": "(?<![A-Za-z0-9])(?:"
    "A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])"
    "|gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255}|glpat-[A-Za-z0-9_-]{20,64}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,64}"
    "|xox[abeprs]-[A-Za-z0-9-]{10,250}|hooks\\.slack\\.com/services/T[A-Z0-9]{6,20}/B[A-Z0-9]{6,20}/[A-Za-z0-9]{16,64}"
    "|[sr]k_(?:live|test)_[A-Za-z0-9]{16,128}|AIza[0-9A-Za-z_-]{35}|SG\\.[A-Za-z0-9_-]{16,64}\\.[A-Za-z0-9_-]{16,64}|sk-(?=[A-Za-z0-9_-]{0,64}[0-9])[A-Za-z0-9_-]{20,256}"
    "|eyJ[A-Za-z0-9_-]{8,}+\\.eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+"
    "|[Bb]earer[\\x20](?=[A-Za-z0-9._~+/-]{0,64}[0-9])[A-Za-z0-9._~+/-]{20,}+=*|AccountKey=[A-Za-z0-9+/]{40,}+=*"
    "|(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb(?:\\+srv)?|rediss?|amqps?)://[^\\s/:@\"'<>]{1,64}:[^\\s/@\"'<>]{3,128}@"
    "|(?i:pass(?:word|wd|phrase)|pwd|secret(?:[_-]?access)?(?:[_-]?key)?|(?:api|access|auth|account)[_-]?key|token)"
    "[\"']?[\\x20\\t]{0,3}[:=][\\x20\\t]{0,3}[\"']?(?=[^\\s\"'<>]{0,64}[0-9])[^\\s\"'<>]{8,}+[\"']?)"
    "|-----BEGIN[A-Z ]{0,30} PRIVATE KEY(?: BLOCK)?-----",
}
BASE = ("email", "ip", "card", "phone")
#: Words nearby that speak for a kind, words that speak against it, the score without either and with the former.
CONTEXT = {
    "email": ("mail|contact|write to|reach", "example\\.", 0.9, 1.0),
    "ip": ("\\bip\\b|address|server|host|login", "version|release|chapter|section", 0.5, 0.8),
    "card": ("card|visa|master|credit|pay", "isbn|serial|tracking", 0.7, 0.95),
    "phone": ("phone|call|tel|mobile|fax", "isbn|serial|formula", 0.6, 0.9),
    "iban": ("iban|bank|account|transfer", "sample|dummy", 0.85, 1.0),
    "secret": ("key|secret|credential|login|aws|auth|user", "placeholder|dummy|changeme", 0.8, 1.0),
}
NEARBY, AGAINST, LEAST = 48, 0.35, 0.5
CHUNK = 128


def luhn(digits: Column) -> Column:
    """Whether the digits pass: every second one from the right is doubled, its digits summed."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.when(c.cast("int") > 4, 1).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether the code, its first four letters moved to the end and letters read as 10 to 35, leaves 1 by 97."""
    turned = F.concat(F.substring(code, 5, 60), F.substring(code, 1, 4))
    step = lambda r, c: F.when(c == "", r).when(c < "A", (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    count = F.length(digits)
    if kind == "ip":
        part = "0*+(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5]|(?<=0))"
        return match.rlike(f"^{part}(?:\\.{part}){{3}}$")
    if kind == "card":
        return F.when(count.between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return count.between(9, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def _pieces(kind: str, text: Column) -> Column:
    """Length of the gap before each match, length of the match, and the match (null after the last)."""
    told = lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h"), h.alias("m"))
    hits = F.col(f"_h_{kind}")
    return F.when(F.size(hits) > 0, F.zip_with(F.split(text, PATTERNS[kind], -1), hits, told))


def _spans(kind: str) -> Column:
    """All matches of the kind as ``array<struct<kind, start, end, ok>>``."""
    hits = f"_h_{kind}"
    pairs = F.col(f"_z_{kind}")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def step(acc, p):
        start = acc["at"] + p["g"]
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + p["h"]).alias("end"))
        out = F.when(p["m"].isNotNull() & confirmed(kind, p["m"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct((start + F.coalesce(p["h"], F.lit(0))).alias("at"), out.alias("out"))

    # in chunks, each of which starts where those before it end: arrays that grow stay short
    chunks = F.transform(F.sequence(F.lit(0), F.size(hits), F.lit(CHUNK)), lambda c: F.slice(pairs, c + 1, F.lit(CHUNK)))
    width = lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, p: n + p["g"] + F.coalesce(p["h"], F.lit(0)))
    grow = lambda acc, chunk: F.struct(
        (acc["at"] + width(chunk)).alias("at"),
        F.concat(acc["out"], F.array(F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), step, lambda a: a["out"]))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<kind:string,start:int,end:int>>>").alias("out"))
    return F.when(F.size(hits) > 0, F.flatten(F.aggregate(chunks, start, grow, lambda a: a["out"]))).otherwise(none)


def find_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, ``_t`` (the text, never null) and ``spans``: ``array<struct<kind,start,end,score>>``."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    marks = {"email": F.contains("_t", F.lit("@")), "phone": F.contains("_t", F.lit("+"))}
    none = F.array().cast("array<string>")
    found = {f"_h_{k}": F.regexp_extract_all("_t", F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    rows = rows.withColumns({c: F.when(marks[c[3:]], x).otherwise(none) if c[3:] in marks else x for c, x in found.items()})
    rows = rows.withColumns({f"_z_{k}": _pieces(k, F.col("_t")) for k in PATTERNS})
    rows = rows.withColumns({f"_s_{k}": _spans(k) for k in PATTERNS})

    def scored(kind):
        told = F.transform(f"_s_{kind}", lambda s: with_score(s, *CONTEXT[kind]))
        return told if kind in BASE else F.filter(told, lambda s: s["score"] >= LEAST)

    def with_score(s, words, against, low, high):
        before = F.substring(F.col("_t"), F.greatest(s["start"] - NEARBY, F.lit(0)) + 1, F.least(s["start"], F.lit(NEARBY)))
        near = F.lower(F.concat(before, F.lit("\n"), F.substring(F.col("_t"), s["end"] + 1, F.lit(NEARBY))))
        score = F.when(near.rlike(words), high).otherwise(low) - F.when(near.rlike(against), AGAINST).otherwise(0.0)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    kinds = [scored(k) for k in PATTERNS]
    return rows.select(*[F.col(f"`{c}`") for c in keep], "_t", F.concat(*kinds).alias("spans"))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key, ``n_email, n_ip, n_card, n_phone, base_sha256, spans``, and ``scores`` in the order of the spans."""
    rows = find_spans(docs, [key]).drop("_t")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return rows.select(
        key, *[count(k) for k in BASE], F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )


def masked(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents with every span of at least that score replaced by ``<kind>``; overlapping spans become one.

    All columns stay; null texts stay null.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    rows = find_spans(packed, ["_doc"])
    chosen = F.array_sort(F.transform(F.filter("spans", lambda s: s["score"] >= least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = rows.withColumn("_c", chosen)
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def join(done, s):
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(last.isNotNull() & (last["end"] > s["start"]), F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(s)))

    rows = rows.withColumn("_m", F.when(F.size("_c") > 0, F.aggregate("_c", empty, join)).otherwise(empty))

    def piece(s, i):
        from_ = F.coalesce(F.get("_m", i - 1)["end"], F.lit(0))
        return F.concat(F.substring(F.col("_t"), from_ + 1, s["start"] - from_), F.lit("<"), s["kind"], F.lit(">"))

    tail = F.substring(F.col("_t"), F.try_element_at("_m", F.lit(-1))["end"] + 1, F.length("_t"))
    text = F.when(F.size("_m") > 0, F.concat(F.array_join(F.transform("_m", piece), ""), tail)).otherwise(F.col("_t"))
    text = F.when(F.col("_doc.text").isNotNull(), text)
    return rows.select(*[text.alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns])
