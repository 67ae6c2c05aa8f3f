"""Packing (5) and token files (7): exact round trips."""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keystrata.llm.binary_output import op7_binary_output, read_tokens, write_tokens
from keystrata.llm.packing import STEP_TOKENS, TIERS, op5_packing, pack_documents
from keystrata.llm.shared import shared_dir
from keystrata.llm.tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


def _ids(text, end):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [end]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aAbÉéßẞİΣσς'’-—.,_<|>endoftext 0123½²́  \t\n\r\x0b\x0c\x1c\x85s't're漢字ªµºĄą€😀")), max_size=40))
def test_cached_words_equal_the_library(text):
    assert encoder(PATH).encode([text], 7)[0].tolist() == _ids(text, 7)


def test_texts_together_and_other_tokenizers():
    texts = ["Ça va? 12ab, l'eau Œuvre", None, "x" * 70000, "a<|b c", "e\u0301té ok", "one two. THREE!"] * 3
    assert [x.tolist() for x in encoder(PATH).encode(texts, 7)] == [_ids(t, 7) for t in texts]
    other = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(other)
    assert [x.tolist() for x in encoder(other).encode(texts, 7)] == [plain.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]


def test_special_tokens_in_a_text():
    for text in ("a<|endoftext|>b", "<|endoftext|>", "x <|startoftext|>. <|end"):
        assert encoder(PATH).encode([text], 0)[0].tolist() == _ids(text, 0)


def _check_files(docs, spark):
    manifest = write_tokens(docs, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}", PATH, end_id=1)
    rows = sorted(read_tokens(manifest).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id, _ids(r.text, 1)) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == sorted((str(i), x) for i, x in want)
    start = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (start, len(r.ids) // 4)
        start += r.n_tokens


def test_files_of_odd_documents(spark, odd_docs, no_docs):
    _check_files(odd_docs, spark)
    assert read_tokens(write_tokens(no_docs, f"{shared_dir(spark)}/none", PATH, end_id=1)).count() == 0


def test_op7(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    start = 0
    for r in sorted(op7_binary_output(spark, sf_dir).collect(), key=lambda r: r.doc_id):
        ids = _ids(texts.pop(r.doc_id), 1)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not texts


def _check_pieces(pieces, docs):
    windows, parts = defaultdict(list), defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
        parts[p.doc_id, p.doc_tokens].append(p)
    for some in windows.values():
        offset = 0
        for p in sorted(some, key=lambda p: p.offset):
            assert p.offset == offset and p.length == len(p.ids) // 4 > 0
            offset += p.length
        assert offset == some[0].context <= TIERS[-1] and offset & (offset - 1) == 0  # nothing is padded
    got = sorted((str(i), n, sum(p.length for p in some)) for (i, n), some in parts.items())
    want = defaultdict(int)
    for r in docs:
        n = len(_ids(r.text, 2))
        want[str(r.doc_id), n] += n
    assert got == sorted((i, n, total) for (i, n), total in want.items())
    groups = defaultdict(int)
    for some in windows.values():
        groups[some[0].step_group] += some[0].context
    last = {g >> 40: max(x for x in groups if x >> 40 == g >> 40) for g in groups}
    assert all(n == STEP_TOKENS or last[g >> 40] == g and n <= STEP_TOKENS for g, n in groups.items() if g >> 40)


def test_packing_of_odd_documents(odd_docs, no_docs):
    _check_pieces(pack_documents(odd_docs, PATH, 2).collect(), odd_docs.collect())
    assert pack_documents(no_docs, PATH, 2).count() == 0


def test_op5(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack_documents(docs, PATH, 2).collect()
    _check_pieces(pieces, docs.collect())
    texts = {r.doc_id: _ids(r.text, 2) for r in docs.collect()}
    for p in op5_packing(spark, sf_dir).collect():
        assert p.ids_crc32 == zlib.crc32(np.array(texts[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
