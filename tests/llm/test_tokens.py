"""BPE and the ORC output against the tokenizers library."""
import hashlib
import random
import weakref
import zlib
from zlib import crc32 as zlib_crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripwire.llm import bpe, language_id, token_orc
from tripwire.llm.common import BoundedCache

EDGES = ["", " ", "  ", "a  b", " a", "a ", "a\n b\n", "x\x85 y", "x\x1c y", "\x1c\x1d  b", "<|endoftext|>", "a <|endoftext|> b", "  <|endoftext|>  x",
         "don't I'LL 's ' s", "日本語 テキスト  émoji 👩‍👩‍👧 x", "123 4567 ²³ ½", "\r\n\r\n x\t\ty   z", "x" * 3000, "y " + "z" * 500 + " w", "\ufeffabc", "a\x00b \x0b\x0c c"]


def texts():
    random.seed(3)
    alphabet = "ab Z1'é\n\t \x85\x1c\u00a0\u3000日.!?-_<|>İß"
    return EDGES + ["".join(random.choice(alphabet) for _ in range(random.randint(1, 40))) for _ in range(3000)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_codec_equals_library(library):
    own, other = bpe.codec(), token_orc.encoder()
    every = texts()
    for text, orc in zip(every, other.encode(every)):
        want = library.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert orc == ids, text
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_small_caches_change_nothing(library):
    path = public_tokenizers.path("byte_bpe_50k.json")
    small, every = bpe.BpeCodec(path, cache_entries=8), texts()
    assert [small.encode(t) for t in every] == [bpe.codec().encode(t) for t in every]
    orc = token_orc.LibraryEncoder(path, cache_entries=4)
    assert [orc.encode([t])[0] for t in every[:300]] == [bpe.codec().encode(t) for t in every[:300]]


def test_bounded_cache_keeps_two_generations():
    asked = []
    cache = BoundedCache(lambda k: asked.append(k) or k + 1, 3)
    for k in range(10):
        assert cache[k] == k + 1
        assert len(cache) <= 3 and len(cache.old) <= 3
    assert cache[9] == 10 and asked == list(range(10))


def test_documents_edges(docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "the cat"), (3, "the cat"), (None, "dog"), (4, "w" * 200_000)], extra=["ids", "n_tokens"])
    rows = {(r.doc_id, r.n_tokens): r for r in bpe.round_trip_digests(docs).collect()}
    assert bpe.round_trip_digests(docs).count() == 6
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[1, 0].ids_sha256 == rows[2, 0].decoded_sha256 == empty
    assert rows[3, 2].decoded_sha256 == hashlib.sha256(b"the cat").hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(docs))
    assert sorted(r.text for r in back.collect()) == sorted(["", "", "the cat", "the cat", "dog", "w" * 200_000])
    assert bpe.round_trip_digests(docs_of([])).count() == 0


def test_orc_files(spark, docs_of, folder, library):
    docs = docs_of([(7, "seven of them"), (2, None), (5, "five"), (5, "five"), (9, "nine\n nine"), (1, "")], extra=["start"])
    token_orc.write_tokens(docs, folder + "/t", parts=3)
    rows = [(r.doc_id, r.start, r.n_tokens, r.ids) for r in token_orc.read_tokens(spark, folder + "/t").orderBy("doc_id", "start").collect()]
    assert [r[0] for r in rows] == [1, 2, 5, 5, 7, 9]
    assert [r[1] for r in rows] == [0, *np.cumsum([r[2] for r in rows])[:-1].tolist()]
    for doc_id, _, n, ids in rows:
        text = {7: "seven of them", 5: "five", 9: "nine\n nine"}.get(doc_id, "")
        assert ids == [*library.encode(text, add_special_tokens=False).ids, token_orc.END_ID] and n == len(ids)
    sums = {r.doc_id: r.ids_crc32 for r in token_orc.checksums(token_orc.read_tokens(spark, folder + "/t")).collect()}
    assert all(sums[i] == zlib.crc32(np.array(ids, "<u4").tobytes()) for i, _, _, ids in rows)
    assert token_orc.read_tokens(spark, folder + "/t").filter(F.col("doc_id") == 7).count() == 1
    token_orc.write_tokens(docs_of([]), folder + "/none", parts=2)
    assert token_orc.read_tokens(spark, folder + "/none").count() == 0


def test_new_runs_are_encoded_once(library):
    orc = token_orc.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"), cache_entries=3)
    asked, encode = [], orc._encode
    orc._encode = lambda some: asked.extend(some) or encode(some)
    for text, fresh in [("a bb cc bb", " bb cc"), ("a bb dd cc", " dd"), ("b ee ff! bb", " ee ff!"), ("c bb cc", "")]:
        asked.clear()
        assert np.frombuffer(orc.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert sorted("".join(a for a in asked if a[0] == " ").split()) == sorted(fresh.split())


def test_checksums_copy_no_batch(monkeypatch):
    """The ids of a batch are read where they are, however many slices it has."""
    seen = []
    monkeypatch.setattr(token_orc.zlib, "crc32", lambda ids: seen.append(ids) or zlib_crc32(ids))
    tokens = type("Tokens", (), {"select": lambda self, *_: self, "mapInArrow": lambda self, run, schema: run})()
    lists = pa.array([[1, 2], [], None, [3]] * 300, pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200)), pa.array(range(1200)), pa.array([1] * 1200), lists], names=["doc_id", "start", "n_tokens", "ids"])
    out = pa.Table.from_batches(list(token_orc.checksums(tokens)(iter([batch]))))
    want = [zlib_crc32(np.array(x or [], "<u4").tobytes()) for x in lists.to_pylist()]
    assert out.column("ids_crc32").to_pylist() == want and out.column("n_tokens").to_pylist() == [len(x or []) for x in lists.to_pylist()]
    start, size = lists.values.buffers()[1].address, lists.values.buffers()[1].size
    assert all(start <= x.__array_interface__["data"][0] <= start + size for x in seen if len(x))


def test_a_worker_keeps_one_operators_state():
    kept = weakref.ref(bpe.codec())
    assert bpe.codec() is kept()
    language_id.pieces()
    assert kept() is None       # the vocabulary and the caches of the operator before
