import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import table
from tokenizers import Tokenizer

from oddslake.llm import vector_packing as V


@pytest.mark.parametrize("seed", range(5))
def test_fill_keeps_all_limits(seed):
    rng = random.Random(seed)
    demands = np.array([(rng.randrange(1, 900), 1, rng.randrange(0, 500)) for _ in range(300)])
    demands[0] = (5000, 1, 10)
    limits = (1000, 5, 600)
    bins = V.fill(demands, limits)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert all((demands[b].sum(0) <= limits).all() or b == [0] for b in bins)
    least = max(np.ceil(demands[1:].sum(0) / limits))
    assert len(bins) <= 1.35 * least + 1
    assert V.fill(np.empty((0, 3), int), limits) == []


def test_pieces_are_the_tokenizers_ids(docs, rows, none):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    found = V.pack_documents(docs).collect()
    got, copies = defaultdict(Counter), Counter(i for i, *_ in rows)
    for r in found:
        got[r["doc_id"]][r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    for i, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want = {(a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)): copies[i] for a in range(0, len(ids), 2048)}
        assert dict(got[i]) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    used = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        used += at
        assert at <= 2048 and len(parts) <= V.LIMITS[1]
    assert used / (2048 * len(sequences)) > 0.9
    assert V.pack_documents(none).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|> and 's  two  blanks\n\n\tend ", "日本語 🙂 ünï  ", "a" * 5000, "\ud800".encode("utf-16", "surrogatepass").decode("utf-16", "replace")])
def test_special_texts(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = V.token_ids(text, public_tokenizers.path(V.RANKS_FILE))
    assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_same_sequences_on_a_rerun(spark):
    rows = spark.createDataFrame([(i, 1 + i * 37 % 700, i * 11 % 300) for i in range(500)], "row BIGINT, tokens BIGINT, loss_tokens BIGINT")
    first, again = (sorted(map(tuple, V.pack(rows.repartition(n), (1000, 4, 400), 100).collect())) for n in (2, 5))
    assert first == again and len(first) == 500


def test_added_tokens_are_those_of_an_unchanged_tokenizer(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}\n {end}  x", f"one\n\n{end}two {end[:-1]} {end.upper()}", f"𝔘 {end}ü " * 900]
    found = {}
    for r in V.pack_documents(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect():
        found.setdefault(r["doc_id"], set()).add((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert 50256 in ids
        assert found[i] == {(a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)}, text[:40]
