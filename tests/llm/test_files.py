import base64
import hashlib
import io
import os
import zlib
from functools import partial

import numpy as np
import pyarrow.fs
import pytest
import zstandard
from pyspark.sql import functions as F

from tagweave.errors import CurationError
from tagweave.llm import pieces, token_files, warc
from tagweave.llm.files import write_whole
from tagweave.llm.queries import PIECE_MODEL, WORD_TOKENIZER

ODD = "abcdeTHE  \n\t▁'s01ßé 　Σ́#$<|>中😀\x00\x1f\u0085İ"


def odd_texts(chance, count):
    parts = [*ODD, "  ", "<|endoftext|>", "<s>", "</s>", "<0x0A>", " ▁ ", "'ll"]
    return ["".join(chance.choices(parts, k=chance.randint(0, 25))) for _ in range(count)]


def library_ids(text):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_TOKENIZER).encode(text or "", add_special_tokens=False).ids


def test_word_encoder_matches_the_library(chance, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "TABLE_WORDS", 50)  # the table starts anew many times
    whole, own = Tokenizer.from_file(WORD_TOKENIZER), token_files.WordEncoder(WORD_TOKENIZER)
    for text in odd_texts(chance, 3000):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_go_by_the_library(tmp_path):
    """A file whose front is not the one restated: case is kept and pieces cross blanks."""
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    assert token_files.cuts_words(WORD_TOKENIZER)
    vocab = {c: i for i, c in enumerate("abAB ")} | {"a b": 5, " b": 6}
    other = Tokenizer(models.BPE(vocab=vocab, merges=[(" ", "b"), ("a", " b")]))
    other.save(f"{tmp_path}/plain.json")
    other.normalizer = normalizers.Lowercase()
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(f"{tmp_path}/lower.json")
    for name in ("plain", "lower"):
        path = f"{tmp_path}/{name}.json"
        encoder, library = token_files.WordEncoder(path), Tokenizer.from_file(path)
        assert not token_files.cuts_words(path)
        for text in ("a b A B", "ab aB  b", "", "B a b"):
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["one text", None])
def test_a_hot_id_is_dealt_to_several_shards(spark, make_docs, tmp_path, text):
    rows = [(None, text, "en", "a")] * 300 + [(1, f"text {i}", "en", "a") for i in range(300)] + [(i, "x", "en", "a") for i in range(2, 20)]
    shards = token_files.write_token_files(make_docs(rows), str(tmp_path), lambda: token_files.word_encoder(WORD_TOKENIZER).encode, shards=6)
    assert sum(n for _, n, _ in shards) == 618 and max(n for _, n, _ in shards) < 250
    read = token_files.read_token_files(spark, str(tmp_path), shards).orderBy("start", F.octet_length("ids").desc()).collect()
    assert [r["doc"] for r in read] == [None] * 300 + [1] * 300 + list(range(2, 20))


def test_token_files_round_trip(spark, make_docs, corpus, tmp_path):
    folder, path = f"file://{tmp_path}/ids", WORD_TOKENIZER
    shards = token_files.write_token_files(make_docs(corpus), folder, lambda: token_files.word_encoder(path).encode, shards=3)
    rows = token_files.read_token_files(spark, folder, shards).orderBy("start").collect()
    expected = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for row, (doc, text, *_) in zip(rows, expected, strict=True):
        ids = [*library_ids(text), 1]
        assert (row["doc"], row["start"], np.frombuffer(row["ids"], "<u4").tolist()) == (doc, start, ids)
        start += len(ids)
    empty = token_files.write_token_files(make_docs(corpus).limit(0), f"{folder}-none", lambda: token_files.word_encoder(path).encode)
    assert sum(d for _, d, _ in empty) == 0 and token_files.read_token_files(spark, f"{folder}-none", empty).collect() == []


def framed(tmp_path, docs, frame_bytes):
    path = tmp_path / "x.ids"

    def fill(out):
        writer = token_files.FrameWriter(out, frame_bytes)
        for doc, ids in docs:
            writer.add(doc, np.array(ids, "<u4").tobytes())
        writer.close()

    write_whole(f"file://{path}", fill)
    return path


def test_readers_decompress_only_what_they_need(tmp_path):
    docs = [(i, list(range(i * 10, i * 10 + 1 + i % 40))) for i in range(400)] + [(None, []), (900, list(range(5000)))]
    path = framed(tmp_path, docs, 1024)
    with pyarrow.fs.LocalFileSystem().open_input_file(str(path)) as source:
        reader = token_files.FrameReader(source)
        for place in (399, 0, 200, 400, 401):
            assert np.frombuffer(reader.ids(place), "<u4").tolist() == docs[place][1]
        assert reader.frames_read < len(reader.sums)
        assert reader.index["known"].tolist().count(0) == 1
    # the file is a plain zstandard stream, its index and seek table are skipped
    with zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True) as plain:
        assert np.frombuffer(plain.read(), "<u4").tolist() == [x for _, ids in docs for x in ids]


def test_a_changed_frame_is_noticed(tmp_path):
    path = framed(tmp_path, [(1, list(range(100)))], 1 << 20)
    table = path.read_bytes()
    path.write_bytes(table[: -token_files.FOOTER.size - 4] + b"\0\0\0\0" + table[-token_files.FOOTER.size :])
    with pyarrow.fs.LocalFileSystem().open_input_file(str(path)) as source, pytest.raises(CurationError):
        token_files.FrameReader(source).ids(0)


def test_words_of_letters_are_not_cut(monkeypatch):
    class Uncut:
        def findall(self, text):
            raise AssertionError(text)

    own = token_files.WordEncoder(WORD_TOKENIZER)
    monkeypatch.setattr(token_files, "PIECE", Uncut())
    text = "Über the ÉCOLE straße ÿ A ouanelle"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == own.words.tokenizer.encode(text, add_special_tokens=False).ids
    with pytest.raises(AssertionError):
        own.encode("it's")


def test_pieces_match_the_library(chance, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 50)
    own = pieces.ChunkEncoder(PIECE_MODEL)
    assert own.by_chunk
    for text in odd_texts(chance, 3000):
        assert own.encode(text).tolist() == own.model.encode(text)


def test_common_chunks_outlive_a_full_table(chance, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 60)
    own = pieces.ChunkEncoder(PIECE_MODEL)
    for turn in range(40):
        text = " ".join(["the", *(f"w{turn}x{i}" for i in range(9)), "house"])
        assert own.encode(text).tolist() == own.model.encode(text)
        assert pieces.MARK + "the" in own.chunks and len(own.chunks) + len(own.older) <= 60 + 2 * 11
    assert own.older


def test_encode_pieces(make_docs, corpus):
    docs = make_docs(corpus)
    rows = pieces.encode_pieces(docs, PIECE_MODEL).select("row.doc_id", "row.size", "ids", "decoded").collect()
    model = pieces.ChunkEncoder(PIECE_MODEL).model
    expected = [(doc, "x", model.encode(text or ""), model.decode(model.encode(text or ""))) for doc, text, *_ in corpus]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected))
    assert pieces.encode_pieces(docs.limit(0), PIECE_MODEL).collect() == []


PAGES = [
    (5, "http://b.org/x", "<p>same</p>"), (3, "http://a.b.org/y?q=1#f", "<p>same</p>"), (9, "http://b.org/x", "<p>same</p>"), (4, None, None),
    (8, "", ""), (7, "no scheme", "<p>ü\r\n\r\nWARC/1.1\r\n</p>"), (None, "http://b.org/x", "<p>same</p>"), (6, "http://b.org/x\r\nY: z", "x" * 200_000),
    (6, "http://b.org/x", "x" * 200_000), (2, "http://b.org/x", "y"),
]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "c", "d") for p in PAGES], "page_id LONG, url STRING, html STRING, payload STRING, sha1 STRING")
    index = warc.write_archives(pages, f"file://{tmp_path}/warc", time=F.format_string("2024-01-%02dT00:00:00Z", F.coalesce("page_id", F.lit(1))))
    records = warc.read_archives(spark, index)
    facts = warc.payload_facts(records).select("page", "payload_bytes", "digest", "record_type", "refers_to").collect()
    smallest = {}
    for page, _, html in PAGES:
        if page is not None:
            smallest[html or ""] = min(smallest.get(html or "", page), page)
    expected = []
    for page, _, html in PAGES:
        content, first = (html or "").encode(), smallest[html or ""]
        again = page is not None and page != first
        digest = base64.b32encode(hashlib.sha1(content).digest()).decode()
        expected.append((page, len(content), digest, "revisit" if again else "response", first if again else None))
    assert sorted(map(repr, map(tuple, facts))) == sorted(map(repr, expected))
    small = warc.write_archives(pages, f"file://{tmp_path}/large", min_bytes=100)
    assert sorted(r["page"] for r in small.where("record_type = 'revisit'").collect()) == []

    merged = warc.capture_histories(index, ranges=3).orderBy("part", "place").collect()
    order = [(r["url_key"].encode(), r["time"], r["page"] is not None, r["page"] or 0) for r in merged]
    assert order == sorted(order) and len(merged) == len(PAGES)
    for row in merged:  # a record can be read from its index entry alone
        with open(row["archive"].removeprefix("file://"), "rb") as source:
            source.seek(row["offset"])
            fields, _ = warc.parse_record(zlib.decompress(source.read(row["length"]), 31))
        assert fields["WARC-Type"] == row["record_type"]
    none = warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert none.collect() == [] and warc.read_archives(spark, none).collect() == [] and warc.capture_histories(none).collect() == []


def test_cut_archive_raises():
    raw = warc.gzip.compress(warc.record_bytes(1, "http://a/", "t", b"abc", warc.digest_of(b"abc"), None), mtime=0)
    assert [f["WARC-Type"] for f, *_ in warc.read_records(io.BytesIO(raw * 3))] == ["response"] * 3
    with pytest.raises(CurationError):
        list(warc.read_records(io.BytesIO(raw + raw[:-9])))


def test_loser_tree(chance):
    for runs in range(0, 9):
        lists = [sorted(chance.choices(range(50), k=chance.randint(0, 20))) for _ in range(runs)]
        assert list(warc.LoserTree([iter(x) for x in lists], lambda x: x)) == sorted(sum(lists, []))


def test_a_file_appears_whole_or_not_at_all(tmp_path):
    def fail(out):
        out.write(b"half")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        write_whole(f"file://{tmp_path}/f", fail)
    assert not (tmp_path / "f").exists()
    write_whole(f"file://{tmp_path}/f", partial(lambda out, b: out.write(b), b=b"1"))
    write_whole(f"file://{tmp_path}/f", partial(lambda out, b: out.write(b), b=b"2"))
    assert (tmp_path / "f").read_bytes() == b"2"
