"""SentencePiece encoding and decoding through a table of distinct chunks.

A model none of whose pieces holds a whitespace marker after another character never merges across the start of
a run of markers. So a text's ids are the ids of its marked words, one after the other. Documents are written once, in
compressed blocks, to the shared folder. Each block names its distinct marked words; every word goes to one task by its
hash, is segmented there once by the library and comes back as ids in the order asked; the block, read again, then joins
ids to its words by position. Texts cross no shuffle, and a task that is run again finds the same blocks. In a task each
distinct word of a block is one object, however often it occurs, so what it holds is some times the block's bytes at most.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import shared_dir, small_batches, staged, store, texts

MARK = "▁"
_RUN = re.compile(" +[^ ]*")
_CROSSING = re.compile(f"[^{MARK}]{MARK}")
_CACHE_WORDS = 400_000
_TOLD_WORDS = 20_000  # so many words go to the library at once


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = f"  AÅﬁ ①\n{MARK}́ "
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("the model rewrites characters or drops spaces; its words cannot be segmented apart")
    if sp.get_piece_size() > 1 << 16:
        raise ValueError("piece ids must fit 16 bits")
    if any(_CROSSING.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
        raise ValueError("a piece crosses a whitespace marker; its words cannot be segmented apart")
    return sp


def words_of(text: str | None) -> list[str]:
    """The marked words of a text in order, each without its first marker; a later marker of a run is a space."""
    s = (text or "").replace(MARK, " ")
    if not s:
        return []
    if "  " not in s and s[0] != " " and s[-1] != " ":
        return s.split(" ")
    return [x[1:] for x in _RUN.findall(" " + s)]


def _pack(items: list[bytes]) -> bytes:
    raw = np.fromiter(map(len, items), dtype="<u4", count=len(items)).tobytes() + b"".join(items)
    return len(items).to_bytes(4, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:4], "little")
    raw = pa.decompress(blob[12:], int.from_bytes(blob[4:12], "little"), codec="zstd", asbytes=True)
    ends = np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)) + 4 * n
    at = 4 * n
    out = []
    for end in ends.tolist():
        out.append(raw[at:end])
        at = end
    return out


_PACKED = pa.schema([("part", pa.int64()), ("nth", pa.int64()), ("path", pa.string())])
_REQUEST = pa.schema([("block", pa.int64()), ("path", pa.string()), ("part", pa.int64()), ("words", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("path", pa.string()), ("part", pa.int64()), ("ids", pa.binary()), ("odd", pa.binary()), ("odd_text", pa.binary())])


def _packs(folder: str, block_bytes: int):
    """Documents to files of about block_bytes of text; a row for each file, numbered within its task."""

    def run(batches):
        task, nth, held, size = TaskContext.get().partitionId(), 0, [], 0

        def packed():
            nonlocal nth, held, size
            path = f"{folder}/{uuid.uuid4().hex}.docs"
            there, place = store(path)
            there.create_dir(place.rpartition("/")[0], recursive=True)
            with there.open_output_stream(place, compression=None) as f, pa.ipc.new_stream(f, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            row = pa.RecordBatch.from_arrays([pa.array([task]), pa.array([nth]), pa.array([path])], schema=_PACKED)
            nth, held, size = nth + 1, [], 0
            return row

        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= block_bytes:
                yield packed()
        if held:
            yield packed()

    return run


def _unpacked(path: str) -> tuple[list[int | None], Iterator[str | None]]:
    """doc_ids and texts of a block; the texts are made as they are asked for."""
    there, place = store(path)
    with there.open_input_stream(place, compression=None) as f:
        t = pa.ipc.open_stream(f).read_all()
    return t.column("doc_id").to_pylist(), (x for k in range(0, t.num_rows, 64) for x in t.column("text").slice(k, 64).to_pylist())


def _distinct(texts: Iterator[str | None]) -> tuple[list[list[str]], dict[str, str]]:
    """The words of each text, and the distinct ones in the order of their first place; equal words are one object."""
    seen: dict[str, str] = {}
    words = []
    for text in texts:
        own = words_of(text)
        words.append(list(map(seen.setdefault, own, own)))
    return words, seen


def _by_part(distinct: dict[str, str], parts: int) -> list[list[str]]:
    """A block's distinct words dealt to parts by hash."""
    split: list[list[str]] = [[] for _ in range(parts)]
    for word in distinct:
        split[zlib.crc32(word.encode()) % parts].append(word)
    return split


def _requests(parts: int):
    """Each block's distinct words, a row for each part that has some; one row at least."""

    def run(batches):
        for batch in batches:
            for block, path in zip(*(batch.column(c).to_pylist() for c in ("block", "path"))):
                seen: dict[str, None] = {}
                for text in _unpacked(path)[1]:
                    seen.update(dict.fromkeys(words_of(text)))
                split = _by_part(seen, parts)
                del seen
                for k, w in enumerate(split):
                    if w or not k:
                        packed = _pack([x.encode() for x in w])
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((block, path, k, packed), _REQUEST.types)], schema=_REQUEST)

    return run


def _segment(path: str):
    def run(batches):
        sp = _model(path)
        known: dict[bytes, bytes] = {}
        odd: dict[bytes, bytes] = {}  # words that decode to something else than themselves
        alone = np.array([sp.piece_to_id(MARK)], "<u2").tobytes()
        for batch in batches:
            for block, source, part, blob in zip(*(batch.column(c).to_pylist() for c in _REQUEST.names)):
                words = _unpack(blob)
                if len(known) > _CACHE_WORDS:
                    known.clear()
                    odd.clear()
                new = [w for w in words if w not in known]
                for k in range(0, len(new), _TOLD_WORDS):
                    plain = [w.decode() for w in new[k : k + _TOLD_WORDS]]
                    ids = sp.encode(plain, num_threads=1)
                    for raw, word, x, decoded in zip(new[k : k + _TOLD_WORDS], plain, ids, sp.decode(ids, num_threads=1)):
                        known[raw] = array("H", x).tobytes() if word else alone
                        if word and decoded != word:
                            odd[raw] = decoded.encode()
                strange = [w for w in words if w in odd] if odd else []
                row = (block, source, part, _pack([known[w] for w in words]), _pack(strange), _pack([odd[w] for w in strange]))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _ANSWER.types)], schema=_ANSWER)

    return run


def _joined(path: str, parts: int, digests: bool):
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *([("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())])])

    def of_block(told: pa.Table) -> pa.Table:
        sp = _model(path)
        begin, end = (np.array([x], "<u4").tobytes() for x in (sp.bos_id(), sp.eos_id()))
        doc_ids, every = _unpacked(told.column("path")[0].as_py())
        asked, seen = _distinct(every)
        del every
        split = _by_part(seen, parts)
        del seen
        ids: dict[str, bytes] = {}
        odd: dict[str, str] = {}
        for part, got, strange, said in zip(*(told.column(c).to_pylist() for c in ("part", "ids", "odd", "odd_text"))):
            ids.update(zip(split[part], _unpack(got), strict=True))
            odd.update((a.decode(), b.decode()) for a, b in zip(_unpack(strange), _unpack(said)))
        del split
        rows = []
        for doc_id, words in zip(doc_ids, asked):
            raw = begin + np.frombuffer(b"".join(map(ids.__getitem__, words)), "<u2").astype("<u4").tobytes() + end
            decoded = " ".join([odd.get(w, w) for w in words] if odd else words)
            if digests:
                rows.append((doc_id, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            else:
                rows.append((doc_id, len(raw) // 4, np.frombuffer(raw, "<i4"), decoded))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, out.types)], schema=out)

    return of_block


def encode_decode(docs: DataFrame, model_path: str, digests: bool = False, block_bytes: int = 16 << 20, max_parts: int = 1024) -> DataFrame:
    """Encodes every whole text with begin and end ids and decodes the ids again.

    Returns doc_id, n_tokens and either ids and decoded (the ids and the text that they decode to) or their
    digests. A null text counts as empty and gives the two outer ids. Repeated rows give a row each; other
    columns of docs are left out; an empty table gives none. A text of any length is encoded whole: a block holds
    about block_bytes of texts, or one longer text. Each block asks at most max_parts tasks, so the number of
    requests grows with the data and not with its square; blocks lie in spark.checkpoint.dir. Raises ValueError for a model whose words cannot be
    told apart (see above).
    """
    _model(model_path)
    spark = docs.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/sentencepiece-{uuid.uuid4().hex}"
    packs = staged(texts(docs).mapInArrow(_packs(folder, block_bytes), "part long, nth long, path string"), "packs")
    blocks, tasks = packs.agg(F.count(F.lit(1)), F.max("part") + 1).first()
    blocks, tasks = max(1, blocks), tasks or 1
    parts = min(blocks, max_parts)
    # blocks and parts go to tasks by their numbers, so no task has many by chance
    dealt = packs.select((F.col("nth") * tasks + F.col("part")).alias("block"), "path").repartitionById(blocks, F.col("block").cast("int"))
    asked = dealt.mapInArrow(_requests(parts), "block long, path string, part long, words binary")
    told = asked.repartitionById(parts, F.col("part").cast("int")).mapInArrow(_segment(model_path), "block long, path string, part long, ids binary, odd binary, odd_text binary")
    kind = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    back = told.withColumn("block", F.col("block").cast("int")).repartitionById(blocks, "block")
    return back.groupBy("block").applyInArrow(_joined(model_path, parts, digests), f"doc_id long, n_tokens long, {kind}")
