"""Token-id files: packing, random access, and whole round trips against the tokenizer alone."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from quire.llm import tokenids as t

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(t.vocabulary_path())


def plain(tokenizer, rows):
    """(doc_id, start, n_tokens, crc32) by encoding one text after another; rows are in order."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def noise(rng, n):
    letters = [*" '  \n\tsaé1中ก็ ​\x1c\x85ll!-。", "'s", "don't", " <|endoftext|>", " words", " of", " text.\n", "́"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(n)]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 24, 31, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = t.pack(ids, bits)
        assert len(data) == -(-n * bits // 8) and (t.unpack(data, bits, n) == ids).all()


def test_files_give_any_stretch():
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 5000, n, dtype=np.uint32) for n in (0, 3, 700, 1, 0, 64)]
    data = t.build([5, None, -3, 2**62, 5, 6], ids, 13, 4, 99, block=32)
    file, flat = t.TokenFile(data + b"\n"), np.concatenate(ids)
    assert (file.part, file.before, file.n_ids) == (4, 99, len(flat))
    assert [(n, s) for n, s, _ in file.documents()] == [(5, 0), (None, 0), (-3, 3), (2**62, 703), (5, 704), (6, 704)]
    assert all((a == b).all() for (_, _, a), b in zip(file.documents(), ids, strict=True))
    for start in range(0, len(flat), 37):
        assert (file.ids(start, min(len(flat), start + 50)) == flat[start : start + 50]).all()
    for broken in (data[:-1], data[:40], b"x" + data, data + b"more"):
        with pytest.raises(ValueError):
            t.TokenFile(broken)
    with pytest.raises(IndexError):
        file.ids(0, len(flat) + 1)


def test_pieces_give_the_ids_of_whole_texts(tokenizer):
    texts = [*noise(random.Random(3), 4000), "", " ", "a  b", " a", "a ", "one\n two \n three"]
    encoder = t.Encoder(Path(t.vocabulary_path()).read_text())
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizers_see_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts, other = noise(random.Random(4), 200), tokenizers.Tokenizer.from_file(path)
    assert [x.tolist() for x in t.Encoder(Path(path).read_text()).encode(texts)] == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


def test_round_trip(spark, tokenizer, tmp_path):
    rng = random.Random(7)
    texts = [None, "", *noise(rng, 300), "long words " * 20000]
    rows = [(rng.choice([None, *range(-50, 1000)]) if i else None, x, "p", "s") for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Part string, start string").repartition(5)
    got = sorted((tuple(r) for r in t.round_trip(docs, str(tmp_path / "ids")).collect()), key=lambda r: r[1])
    # rows of one id follow each other in any fixed order
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(d), n, c) for d, _, n, c in plain(tokenizer, [r[:2] for r in rows]))
    flat = {(r.doc_id, r.ids_crc32): r.ids for r in t.read_token_ids(spark, str(tmp_path / "ids"), with_ids=True).collect()}
    whole = np.concatenate([flat[r[0], r[3]] for r in got])
    for start in (0, 5, len(whole) // 2, len(whole) - 1):
        stop = min(len(whole), start + 5000)
        assert (t.read_stretch(spark, str(tmp_path / "ids"), start, stop) == whole[start:stop]).all()
    assert t.round_trip(docs.limit(0)).count() == 0


def test_small_segments_make_many_files(spark, tokenizer, tmp_path):
    rows = [(i, "some words here " * (i % 9)) for i in range(200)]
    t.write_token_ids(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "x"), segment=64, block=16)
    assert len(list((tmp_path / "x").glob("part-*"))) > 30
    got = t.read_token_ids(spark, str(tmp_path / "x")).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == [(d, n, c) for d, _, n, c in plain(tokenizer, rows)]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the driver's tables are not here")
def test_query_equals_the_tokenizer(spark, tokenizer):
    from quire.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in QUERIES["op11_token_ids"](spark, "/root/testdata/sf0.001").collect())
    assert got == plain(tokenizer, [tuple(r) for r in rows])


def test_the_tokenizer_gets_few_texts_at_once(monkeypatch):
    encoder = t.Encoder(Path(t.vocabulary_path()).read_text(encoding="utf-8"))
    monkeypatch.setattr(t, "GIVEN", 1000)
    whole, given = encoder.tokenizer, []

    class Recorder:
        def encode_batch(self, texts, **more):
            given.append(sum(map(len, texts)))
            return whole.encode_batch(texts, **more)

    encoder.tokenizer = Recorder()
    texts = [f"tab\t{k}  two" * 20 for k in range(60)]
    got = encoder._ids(texts)
    assert max(given) <= 1000 + max(map(len, texts)) and len(given) > 5
    assert [x.tolist() for x in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert encoder._ids([]) == []


def test_plain_words_are_looked_up_once_and_not_cut(tokenizer, monkeypatch):
    """New words of ASCII letters go to the tokenizer's model as they are, and a field that is known isn't asked for again."""
    encoder = t.Encoder(Path(t.vocabulary_path()).read_text(encoding="utf-8"))

    class Never:
        def findall(self, field):
            raise AssertionError(field)

    monkeypatch.setattr(t, "RUN", Never())
    asked, field = [], encoder.fields.ask
    encoder.fields.ask = lambda word: asked.append(word) or field(word)
    texts = ["First qwopx zzyzx qwopx", "Again zzyzx qwopx of", ""]
    assert [x.tolist() for x in encoder.encode(texts)] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert asked == ["qwopx", "zzyzx", "of"]
