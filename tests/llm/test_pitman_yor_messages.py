"""How the language model numbers its words and packs what its steps send each other."""

import numpy as np
import pyarrow as pa
import pytest

from urbanloom.llm import pitman_yor


def test_words_are_numbered_as_bytes():
    texts = [b"", b" ", b"a", b"  A b\x0bB\x0c\r\n a\t", b"\xff\xfe A\x1c\x85x", "É à x y".encode(), b"\x00 " * 50]
    column = pa.chunked_array([pa.array(texts[:3], pa.binary()), pa.array(texts[2:], pa.binary()).slice(1)])
    token, sizes, spelled = pitman_yor.numbered_words(column)
    wanted = [[*text.lower().split(), pitman_yor.END] for text in texts]
    assert sizes.tolist() == [len(words) for words in wanted]
    assert [spelled[k] for k in token] == [word for words in wanted for word in words]


@pytest.mark.parametrize("values", [[], [0], [255], [256], [1 << 16], [0, (1 << 32) - 1], [1 << 32, 3], [1 << 62]])
def test_whole_numbers_survive_packing(values):
    got = pitman_yor.unpack(pitman_yor.pack(np.array(values, np.int64)))
    assert got.dtype == np.int64 and got.tolist() == values


def test_probabilities_take_less_than_their_bytes():
    log_p = np.log10(np.random.default_rng(0).uniform(1e-6, 1e-2, 20_000)).astype(np.float32)
    table = pa.table({"doc_id": [1, 2], "data": pa.array([b"a b a b", b"c"], pa.binary())})
    tokens = pitman_yor.Tokens(table, (7, 2))
    told = pitman_yor.rows_of([(0, pitman_yor.FOUND, 0, [pitman_yor.planes(np.zeros(len(tokens.word), np.float32)), pitman_yor.pack(np.ones(len(tokens.word), np.int64))], None)])
    scored = pitman_yor._score(pitman_yor.Split(1, {}), (7, 2), 7.0, 4.0)(table, told)
    assert scored["score"].to_pylist() == [0.0, 0.0] and scored["n_tokens"].to_pylist() == [5, 2]
    blob = pitman_yor.planes(log_p)
    assert len(blob) < 0.9 * log_p.nbytes and np.array_equal(pitman_yor.unplanes(blob, np.float32), log_p)


def test_tasks_take_several_groups(spark, monkeypatch):
    """A step writes at most as many files as the usual partitions if these have few groups each."""
    files = []

    class Counted(pitman_yor.Scratch):
        def write(self, make):
            out = super().write(make)
            files.append(len(out.inputFiles()))
            return out

    monkeypatch.setattr(pitman_yor, "Scratch", Counted)
    texts = [" ".join(f"w{(k * j) % 97}" for j in range(60)) for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    usual, total = int(spark.conf.get("spark.sql.shuffle.partitions")), sum(map(len, texts))
    scored = pitman_yor.score_texts(docs, chunk_bytes=total // (6 * usual), bucket_bytes=total // (3 * usual))
    assert scored.count() == len(texts) and max(files) <= usual
