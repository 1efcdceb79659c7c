import io
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from placelink.llm import packing

PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 20, 31, 32])
def test_pack_and_random_access(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 1_000, dtype=np.uint64).astype("<u4")
    assert packing.unpack(packing.pack(ids, bits), bits, len(ids)).tolist() == ids.tolist()
    out = io.BytesIO()
    writer = packing.Writer(out, bits, block=64)
    cuts = [0, 0, 1, 63, 64, 200, 201, 1_000]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        writer.add(None if k == 2 else k - 3, ids[a:b])
    writer.close()
    held = packing.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert held.doc_ids == [-3, -2, None, 0, 1, 2, 3]
    assert [held.document(k).tolist() for k in range(7)] == [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]
    for a, n in ((0, 0), (5, 1), (63, 2), (100, 500), (999, 1)):
        assert held.ids(a, n).tolist() == ids[a : a + n].tolist()


def test_values_that_do_not_fit_are_refused():
    with pytest.raises(ValueError):
        packing.pack(np.array([8]), 3)
    assert [packing.bits_for(v) for v in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_words_give_the_ids_of_the_whole_text():
    whole, words = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    rng = random.Random(4)
    parts = ["a", "B", "'s", "'", "é", "É", "ß", "İ", " ", "  ", "\n", "\x1c", "\x85", "\xa0", " ", "1", "²", "½", "µ", "-", "<|endoftext|>", "<|", "é", "́", "日本", "\U0001f600", "Σ", "ς", "×", "x" * 70]
    assert words.apart
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3_000)]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time from the cache
        assert [ids.tolist() for ids in words(pa.array(texts))] == want


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 7)
    monkeypatch.setattr(packing, "PARTS", 2)
    whole, words = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    texts = ["", "It's a test of  slices\n", "x" * 100, " " * 50 + "end", "one two " * 40, "É́ " * 30]
    assert [ids.tolist() for ids in words(pa.array(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_with_another_rule_go_to_the_library_whole(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        told = json.load(file)
    assert packing.words_apart(told)
    told["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(told))
    words = packing.WordEncoder(str(other))
    assert not words.apart
    texts = ["Two words", "", "a  b\nc"]
    whole = Tokenizer.from_file(str(other))
    assert [ids.tolist() for ids in words(pa.array(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip(spark):
    whole = Tokenizer.from_file(PATH)
    rows = [(3, "Hello, World!", 1), (-1, None, 2), (None, "no id", 3), (7, "", 4), (7, "again", 5), (7, "again", 6), (5, "long " * 30_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int")
    got = [tuple(r) for r in packing.round_trip(df, PATH).orderBy("start", "n_tokens").collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for doc, text, _ in order:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert packing.round_trip(df.limit(0), PATH).count() == 0
