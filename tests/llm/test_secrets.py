"""Operator 1 against Python's patterns, and its models on held-out strings."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from keystrata.llm import secret_scan as S

PATTERNS = (re.compile(S.ASSIGN), re.compile(S.ACCESS), re.compile(S.HEX))


def _base(text):
    out = []
    for kind, (pattern, least) in enumerate(zip(PATTERNS, (S.ASSIGN_CHARS, S.ACCESS_CHARS, S.HEX_CHARS), strict=True)):
        for m in pattern.finditer(text or ""):
            if len(m[2] if kind == 0 else m[0]) >= least:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def _noise(seed):
    dice = random.Random(seed)
    parts = ["token", "Secret", "API_KEY", "apikey", "passwd", "=", ":", " ", "'", '"', "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef" * 4, "0123456789abcdef", "x", "é", "🙂", "\n", "secret:abcdefgh", "=abcd", "/+._-"]
    return "".join(dice.choice(parts) for _ in range(dice.randint(0, 40)))


def test_base_spans_and_redaction(spark, odd_docs):
    docs = spark.createDataFrame([(i, _noise(i)) for i in range(400)], "doc_id bigint, text string").unionByName(odd_docs.select("doc_id", "text"))
    found = S.find_secrets(docs, S.labelled_samples(spark))
    clean = S.redacted(F.coalesce("text", F.lit("")), F.col("secrets")["spans"], "#").alias("clean")
    n = 0
    for r in found.select("*", clean).collect():
        base = [(s.start, s.kind, s.end) for s in r.secrets.base]
        assert base == _base(r.text)
        n += len(base)
        spans = [(s.start, s.kind, s.end) for s in r.secrets.spans]
        assert spans == sorted(spans) and [s for s in spans if s[1] < 3] == base
        more = [s for s in spans if s[1] == 3]
        assert not any(a[0] < b[2] and b[0] < a[2] for a in more for b in base)
        text, want, at = r.text or "", "", 0
        for start, _, end in spans:
            if start >= at:
                want += text[at:start] + "#"
            at = max(at, end)
        assert r.clean == want + text[at:]
    assert n > 100


def _markov(text, ratios, base):
    """The method's spans by marking characters one by one."""
    place = {c: i for i, c in enumerate(S.ALPHABET)}
    owner = [None] * len(text)

    def mark(known):
        for m in re.finditer(rf"(?<![{known}])[{known}]{{16,}}(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?", text):
            own = m[0].rstrip("=")
            score = sum(ratios[place[a] * len(place) + place[b]] for a, b in zip(own, own[1:], strict=False))
            per_char = 0.35 if re.search("[0-9]", own) else 1.0
            if re.search("[A-Za-z]", own) and score >= 8 and score >= per_char * len(own):
                for i in range(*m.span()):
                    owner[i] = owner[i] or (known, m.start())

    mark("A-Za-z0-9+/_-")
    mark("A-Za-z0-9+_-")
    for start, _, end in base:
        owner[start:end] = [None] * (end - start)
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and owner[end] == owner[at]:
            end += 1
        if owner[at]:
            out.append((at, 3, end))
        at = end
    return out


def test_method_spans_against_brute_force(spark, sf_dir):
    samples = S.labelled_samples(spark, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ratios = S.log_ratios(samples)
    dice = random.Random(5)
    parts = ["/", "=", "==", " ", "_", "-", "AKIA" + "Q7XW2ZLM9PRT4KVB", "deadbeef" * 4, "name_of_the_session", "token=abcdefgh", "é"]
    coded = lambda: base64.b64encode(dice.randbytes(dice.randint(6, 40))).decode()
    rows = [(i, "".join(dice.choice([coded(), dice.choice(parts)]) for _ in range(dice.randint(1, 20)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = 0
    for r in S.find_secrets(docs, samples).collect():
        base = _base(r.text)
        want = _markov(r.text or "", ratios, base)
        assert [(s.start, s.kind, s.end) for s in r.secrets.spans] == sorted(base + want), r.text
        n += len(want)
    assert n > 200


def test_models_do_not_depend_on_partitions(spark, sf_dir):
    prose = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert S.log_ratios(S.labelled_samples(spark, prose)) == S.log_ratios(S.labelled_samples(spark, prose.repartition(7)))


def test_very_many_matches_in_one_text(spark):
    dice = random.Random(3)
    text = " ".join(f"token=abcdefgh{i} {base64.b64encode(dice.randbytes(24)).decode()}" for i in range(20_000))
    blob = "x " + base64.b64encode(dice.randbytes(300_000)).decode()
    docs = spark.createDataFrame([(1, text), (2, blob)], "doc_id bigint, text string").repartition(2)
    found = S.find_secrets(docs, S.labelled_samples(spark)).select("doc_id", F.size("secrets.base").alias("base"), F.size("secrets.spans").alias("spans"), F.length(S.redacted(F.col("text"), F.col("secrets")["spans"])).alias("left"))
    began = time.perf_counter()
    got = {r.doc_id: r for r in found.collect()}
    assert time.perf_counter() - began < 10
    assert got[1].base == 20_000 and got[1].spans >= 39_000 and got[1].left < 500_000
    assert (got[2].base, got[2].left) == (0, len("x [SECRET]"))


def test_names_and_empty_table(spark, odd_docs, no_docs):
    samples = S.labelled_samples(spark)
    assert "secrets_" in S.find_secrets(odd_docs, samples).columns
    assert S.find_secrets(no_docs, samples).count() == 0


def test_models_on_held_out_strings(spark):
    dice = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secrets = ["".join(dice.choice(letters) for _ in range(dice.randint(24, 48))) for _ in range(300)]
    secrets += [base64.b64encode(hashlib.md5(str(i).encode()).digest() * 2).decode().replace("/", "A")[:40] for i in range(100)]
    ordinary = ["_".join(dice.choice(S.IDENTIFIER_WORDS) for _ in range(4)) + f"_{i}" for i in range(200)] + [f"chapter-{i}-of-the-old-testament-version" for i in range(100)] + ["getUserNameFromSession2", "https-example-com-index-page-2024", "2024-01-01-meeting-notes-final"]
    rows = [(i, f"see {x} here") for i, x in enumerate(secrets + ordinary)]
    found = S.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string"), S.labelled_samples(spark))
    hit = {r.doc_id for r in found.filter(F.size("secrets.spans") > 0).collect()}
    assert len(hit & set(range(len(secrets)))) >= 0.95 * len(secrets)
    assert len(hit - set(range(len(secrets)))) <= 0.01 * len(ordinary)


def test_redaction_of_unaltered_strings(spark, sf_dir):
    """Base 64 with its slashes and padding, strings without digits, behind names and paths, and around a base span."""
    dice = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    coded = [base64.b64encode(dice.randbytes(dice.choice((16, 18, 24, 30)))).decode() for _ in range(400)]
    lettered = ["".join(dice.choice(letters) for _ in range(dice.randint(20, 32))) for _ in range(200)]
    named = [f"/usr/local/share/configuration/{x}" for x in ("".join(dice.choice(letters + "0123456789") for _ in range(32)) for _ in range(100))]
    assigned = [f"customer_session_handler_name={x}" for x in coded[:100]]
    around = [f"{x[:20]}AKIA{'Q7XW2ZLM9PRT4KVB'}{x[20:]}" for x in ("".join(dice.choice(letters + "0123456789") for _ in range(40)).replace("K", "k") + "q" for _ in range(100))]
    ordinary = ["/".join(dice.choice(S.IDENTIFIER_WORDS) for _ in range(5)) for _ in range(200)] + ["getUserNameFromSessionConfig", "Donaudampfschifffahrtsgesellschaft", "anticonstitutionnellement", "/home/user/projects/page_index.html", "https://example.com/data/2024/01/page", "internationalization/localization"] * 5
    rows = [(i, f"see {x} here") for i, x in enumerate(coded + lettered + named + assigned + around + ordinary)]
    found = S.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string"), S.labelled_samples(spark, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    clean = {r.doc_id: r.clean for r in found.select("doc_id", S.redacted(F.col("text"), F.col("secrets")["spans"], "#").alias("clean")).collect()}
    at = 0
    for kind, want, share in ((coded, "see # here", 0.97), (lettered, "see # here", 0.95), (named, r"see /usr/local/share/configuration/# here|see # here", 0.97), (assigned, "see customer_session_handler_name=# here", 0.97), (around, "see #+ here", 0.97)):
        assert sum(bool(re.fullmatch(want, clean[at + i])) for i in range(len(kind))) >= share * len(kind), want
        at += len(kind)
    assert sum("#" in clean[at + i] for i in range(len(ordinary))) <= 0.01 * len(ordinary)


def test_op1(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in S.op1_secret_scan(spark, sf_dir).collect():
        base = _base(texts.pop(r.doc_id))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, k, _ in base) for kind in range(3)]
        listed = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and set(listed.split(",")) - {""} <= set(r.spans.split(","))
    assert not texts


def test_op1_counts_each_kind(spark, sf_dir, tmp_path):
    """Several spans of each kind in one text, in any order; letters beyond ASCII match no keyword."""
    hexes, access = "deadbeef" * 4, "AKIA" + "Q7XW2ZLM9PRT4KVB"
    texts = [_noise(i) for i in range(400, 500)] + [None, "", f"{hexes} {hexes} token=abcdefgh {access}", f"token=abcdefgh Secret: '{hexes}' API_KEY=\"abcdefgh", f"{access} {access} {access}", "to\u212aen=abcdefgh \u017fecret=abcdefgh ap\u0131key=abcdefgh", "token=abcdefg AKIA123 0123abc"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    ascii_only = [re.compile(S.ASSIGN, re.ASCII), *PATTERNS[1:]]
    got = {r.doc_id: r for r in S.op1_secret_scan(spark, str(tmp_path)).collect()}
    assert got.keys() == set(range(len(texts)))
    for i, text in enumerate(texts):
        found = sorted((m.start(), k, m.end()) for k, p in enumerate(ascii_only) for m in p.finditer(text or "") if len(m[2] if k == 0 else m[0]) >= (8, 16, 32)[k])
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == kind for _, k, _ in found) for kind in range(3)], text
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest(), text
