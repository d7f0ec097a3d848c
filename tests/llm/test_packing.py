from __future__ import annotations

import io
import zlib

import numpy as np
import pytest
import zstandard
from fixtures import SMALL, edge_rows, edges, empty, prose

from sediment.llm.packing import Reader, Writer, op3_token_files, read_token_files, write_token_files
from sediment.llm.tokens import encoder, vocabulary


def expected(rows) -> list[tuple]:
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(vocabulary())
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def sizes(rows) -> list[tuple]:
    """doc_id, n_tokens, crc of ``rows``, whatever the order of equal ids."""
    return sorted(((r[0], *r[2:]) for r in rows), key=repr)


def by_start(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


def test_round_trip(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert by_start(op3_token_files(spark, SMALL)) == expected(rows)


def test_edges(spark):
    docs = edges(spark).select("doc_id", "text")
    got, want = by_start(read_token_files(write_token_files(docs))), expected([(r[0], r[1]) for r in edge_rows()])
    assert sizes(got) == sizes(want)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(b[1] == a[1] + a[2] for a, b in zip(got, got[1:]))
    assert read_token_files(write_token_files(empty(spark))).collect() == []


@pytest.mark.parametrize("text", ["", " ", "  a", "don't we'll  they're 'S 'sx 's", "a\n\n b\t\tc \n", "<|endoftext|> x", "1234 12a a12", "été  naïve", "中文 \U0001f600!", "!!! ???\r\n  ", "x" * 5000, "\x1c \x1f", "'" * 7 + "s", prose(3, 400)])
def test_ids_are_the_librarys(text):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(vocabulary())
    ids, begin = encoder(vocabulary()).encode([text, "next", text])
    assert ids[: begin[1]].tolist() == tool.encode(text, add_special_tokens=False).ids
    assert ids[begin[2] :].tolist() == tool.encode(text, add_special_tokens=False).ids


def test_ids_of_made_up_strings_are_the_librarys():
    import random

    from tokenizers import Tokenizer

    tool, rng = Tokenizer.from_file(vocabulary()), random.Random(5)
    parts = ["<|endoftext|>", "<|", "|>", "endoftext", " ", "  ", "\n", "'s", "'re", "a", "Zq", "été", "12", "!?", "\u4e2d", "\u00a0", "\x1c", "'", "\r\n", "\U0001f600"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(10_000)]
    ids, begin = encoder(vocabulary()).encode(texts)
    wrong = [t for i, t in enumerate(texts) if ids[begin[i] : begin[i + 1]].tolist() != tool.encode(t, add_special_tokens=False).ids]
    assert wrong == []
    assert any(50256 in ids[begin[i] : begin[i + 1]] for i in range(100))


def test_failed_attempts_leave_no_file(spark, tmp_path):
    (tmp_path / "part-000000-99.tokens.zst").write_bytes(b"half")
    manifest = write_token_files(edges(spark), folder=f"file://{tmp_path}")
    assert {p.name for p in tmp_path.glob("*.zst")} == {r["file"].rsplit("/", 1)[1] for r in manifest.collect()}


def test_one_repeated_row_fills_many_files(spark):
    docs = spark.createDataFrame([(7, "the same row")] * 400 + [(None, prose(i, 9)) for i in range(300)], "doc_id long, text string").repartition(4)
    manifest = write_token_files(docs, files=8)
    assert max(r["docs"] for r in manifest.collect()) < 400
    assert sizes(by_start(read_token_files(manifest))) == sizes(expected([tuple(r) for r in docs.collect()]))


def filled(frame_bytes: int = 64) -> tuple[bytes, list]:
    out = io.BytesIO()
    writer = Writer(out, frame_bytes=frame_bytes)
    docs = [(i if i != 3 else None, np.arange(i, i + 7 * i, dtype=np.uint32)) for i in range(40)]
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    return out.getvalue(), docs


def test_documents_are_read_alone():
    raw, docs = filled()

    class Counting(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            got = super().read(n)
            self.read_bytes += len(got)
            return got

    source = Counting(raw)
    reader = Reader(source)
    assert len(reader.frames) > 10
    before = source.read_bytes
    assert reader.document(17).tolist() == docs[17][1].tolist()
    assert source.read_bytes - before < len(raw) / 4
    assert [reader.document(i).tolist() for i in range(40)] == [d.tolist() for _, d in docs]
    assert not reader.known[3] and reader.known[4]


def test_frames_are_plain_zstandard():
    raw, docs = filled()
    whole = b"".join(d.astype("<u4").tobytes() for _, d in docs)
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read(len(whole)) == whole


def test_damage_is_seen():
    raw, _ = filled()
    reader = Reader(io.BytesIO(raw))
    at = int(reader.at[5]) + int(reader.frames[5, 0]) // 2
    bad = raw[:at] + bytes([raw[at] ^ 0xFF]) + raw[at + 1 :]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        Reader(io.BytesIO(bad)).frame(5)
