"""Places of license phrases by brute force, notices by a table, secrets from a list of their own, rules of tokenizer files."""

import random
import re
import string
from collections import Counter

import public_tokenizers
import pytest

from sessionlake.llm import bpe, license_scan, pii

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def test_license_phrases_by_brute_force(spark):
    """Whole documents, and texts in which phrases overlap, repeat and are cut by other signs; doc_ids may be null."""
    rng = random.Random(5)
    pool = ["cc", "by", "CC-BY", "general", "public", "license", "all", "rights", "Reserved.", "été", "x", "GENERAL public\nlicense", "all rights reserved"]
    planted = [(None if k % 9 == 0 else 10**7 + k, None if k == 3 else " ".join(rng.choice(pool) for _ in range(k * 3))) for k in range(60)]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    want = Counter()
    for r in docs.collect():
        words = WORD.findall(low(r["text"] or ""))
        at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in at]
        want[(r["doc_id"], len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({la for _, la in at})))] += 1
    rows = license_scan.scan_licenses(docs, with_hits=False).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows) == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)


def test_notices_by_a_table(spark):
    table = spark.createDataFrame(
        [("own", "You may copy this work, as long as our name is kept", None), ("own", "Own-License 3", False), (None, "no label here", True), ("empty", "...", True), ("null", None, False)],
        "label string, words string, edits boolean")
    notices, names = license_scan.notices_of(table)
    assert notices == (("own", "you may copy this work as long as our name is kept"),) and names == (("own", "own license 3"),)
    texts = ["You may cpoy this work as long as our name is kept!", "under OWN LICENSE 3.", "own license 33", "permission is hereby granted free of charge to any person obtaining a copy", "all rights reserved"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(docs, notices=notices, names=names).collect()}
    assert got == {0: "own", 1: "own", 2: "", 3: "", 4: "reserved"}
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(docs).collect()}[3] == "mit"
    with pytest.raises(ValueError):
        license_scan.notices_of(table, most=2)


def secrets(rng):
    """Text before, the secret, text after: forms as their issuers document them, written apart from the operator."""
    some = lambda n, letters=string.ascii_letters + string.digits: "".join(rng.choice(letters) for _ in range(n - 1)) + "7"
    upper, web = string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "-_"
    yield "id ", "AKIA" + some(16, upper), " here"
    yield "id ", "ASIA" + some(16, upper), ", temporary"
    yield "export AWS_SECRET_ACCESS_KEY=", some(40, string.ascii_letters + string.digits + "/+"), "\nnext"
    yield "use ", "ghp_" + some(36), " to push"
    yield "use ", "github_pat_" + some(22) + "_" + some(59), " to push"
    yield "CI: ", "glpat-" + some(20, web), ""
    yield "//registry/:_authToken=", "npm_" + some(36), "\n"
    yield "login ", "hf_" + some(34, string.ascii_letters + "7"), " done"
    yield "bot ", f"xoxb-{some(12, string.digits)}-{some(12, string.digits)}-{some(24)}", " posts"
    yield "post to https://", f"hooks.slack.com/services/T{some(8, upper)}/B{some(8, upper)}/{some(24)}", " now"
    yield "charge with ", "sk_live_" + some(24), "."
    yield "charge with ", "rk_test_" + some(24), "."
    yield "maps?key=", "AIza" + some(35, web), "&x=1"
    yield "mail by ", f"SG.{some(22, web)}.{some(43, web)}", " ok"
    yield "ask with ", "sk-" + some(48), " please"
    yield "ask with ", "sk-proj-" + some(48, web), " please"
    yield "Authorization: Bearer ", some(40), "\n"
    yield "jwt ", f"eyJ{some(30, web)}.eyJ{some(60, web)}.{some(43, web)}", " end"
    yield "EndpointSuffix=x;AccountKey=", some(86, string.ascii_letters + string.digits + "+/") + "==", ";"
    yield "connect to ", f"postgres://admin:{some(12)}@", "db.local:5432/x"
    yield "clone ", f"https://me:{some(20)}@", "git.local/a"
    yield 'conf "password": "', some(12), '", more'
    yield "DB_PASSWORD=", some(10), "\n"
    yield "pwd: ", some(9), " is new"
    yield "passphrase = '", some(14), "'"
    yield "client_secret: ", some(32), "\n"
    yield "api-key: ", some(32, "0123456789abcdef"), "\n"
    yield "X-Api-Key: ", some(24), "\n"
    yield "auth_token=", some(24), "&"
    yield "", "-----BEGIN OPENSSH PRIVATE KEY-----", "\nb3Bl"
    yield "", "-----BEGIN PGP PRIVATE KEY BLOCK-----", "\nlQOY"
    yield "my pin for the door is ", some(6, string.digits), ""  # no form at all: missed


CLEAN = (
    "The token economy rests on 21 million tokens.", "A password is hard to guess; change passwords every 90 days.", "secret sauce: tomatoes and basil", "from sk-learn import 5 estimators",
    "the bearer of bad news arrived in 1984", "commit 3f2b8c1d9e7a6f5b4c3d2e1f0a9b8c7d6e5f4a3b", "id 550e8400-e29b-41d4-a716-446655440000", "see https://example.org:8080/a/b?x=1 and http://a.b/c@d",
    "key: value pairs, token: yes", "hugging_face_models are 12", "ASIA is a continent of 49 countries", "npm_install took 30 s", "pass word = none", "SG. Müller. 1. FC Köln", "BEGIN PRIVATE talks KEY points", "the api key is described in chapter 12",
)


def test_secrets_of_an_independent_list(spark):
    """At least nine tenths are found, wherever they stand, and no clean line has any."""
    rng, rows, where = random.Random(12), [], {}
    filler = "Plain words of a report without any keys. "
    for _ in range(8):
        for before, secret, after in secrets(rng):
            lead = filler * rng.randrange(3) + before
            where[len(rows)] = (len(lead), len(lead) + len(secret))
            rows.append((len(rows), lead + secret + after + " " + filler * rng.randrange(2)))
    first_clean = len(rows)
    rows += [(first_clean + k, t) for k, t in enumerate(CLEAN)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("secret")] for r in pii.report(docs).collect()}
    found = [k for k, (a, b) in where.items() if any(s <= a and e >= b for s, e in got[k])]
    assert len(found) >= 0.9 * len(where)
    assert [t for k, t in rows[first_clean:] if got[k]] == []
    kept = {r["doc_id"]: r["text"] for r in pii.masked(docs).collect()}
    told = dict(rows)
    assert all(told[k][a:b] not in kept[k] for k, (a, b) in where.items() if k in set(found)) and all(kept[k] == t for k, t in rows[first_clean:])


def test_other_rules_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="ByteLevel"):
        bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 1
