"""Token ids in binary files: static range asymmetric numeral systems (rANS) with shared frequency tables.

Documents are put in doc_id order over range partitions and encoded to ids. One frequency table, counted over all
ids, serves all blocks. A block holds whole documents and is coded by many interleaved states side by side; every
so many steps it notes the states and the place in the words (a checkpoint), so that parts of a block can be
decoded apart, and each block ends in a checksum. Blocks need nothing of each other.

A folder of token files holds all that a reader needs: `table.rant` (the frequency table), files `*.ranb` of blocks one
after the other, and `index` (Parquet: path, offset, length and first of each block; a block that it does not name does
not count). In little-endian order, a table is: magic RANT, version u16, bits u16, ids u32, digest of the vocabulary
16 bytes, the frequencies u32 each, then the crc32 of all before. A block is: magic RANB, version u16, bits u16,
lanes u32, steps u32, every u32, documents u32, first token u64, ids u64, words u32, checkpoints u32, the table's crc32
u32, then per document its doc_id i64 and ids u32, then per checkpoint the first word u32 and the states u64 x lanes,
then the words u32, then the crc32 of all before.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import block_count, shared_dir, small_batches, staged, store, texts

BITS = 20
LOW = 1 << 31
LANES = 512
EVERY = 256
BLOCK_IDS = 1 << 18
_HEAD = struct.Struct("<4sHHIIIIQQIII")
_TABLE = struct.Struct("<4sHHI16s")


# --- the coder -----------------------------------------------------------------------------------------------


def frequency_table(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to a sum of 2**bits; whatever occurs keeps at least 1."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.uint32)
    freq = np.maximum((counts.astype(np.float64) * (size / total)).astype(np.int64), counts > 0)
    order = np.argsort(-freq, kind="stable")
    over = int(freq.sum()) - size
    if over < 0:
        freq[order[0]] -= over
    for k in order:
        if over <= 0:
            break
        cut = min(over, int(freq[k]) - 1)
        freq[k] -= cut
        over -= cut
    return freq.astype(np.uint32)


def pack_table(freq: np.ndarray, vocabulary: bytes, bits: int = BITS) -> bytes:
    body = _TABLE.pack(b"RANT", 1, bits, len(freq), hashlib.blake2b(vocabulary, digest_size=16).digest()) + freq.astype("<u4").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def open_table(raw: bytes) -> tuple[bytes, int]:
    """The frequencies, 4 bytes each, and the table's crc32; ValueError where that or the magic does not hold."""
    if len(raw) < _TABLE.size + 4 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("a table's checksum does not hold")
    magic, version, _, size, _ = _TABLE.unpack_from(raw)
    if magic != b"RANT" or version != 1 or len(raw) != _TABLE.size + 4 * size + 4:
        raise ValueError("not a table of this format")
    return raw[_TABLE.size : -4], zlib.crc32(raw[:-4])


def encode_block(ids: np.ndarray, docs: list[tuple[int, int]], first: int, freq: np.ndarray, bits: int = BITS, lanes: int = LANES, every: int = EVERY, table_crc: int = 0) -> bytes:
    """ids as one block; docs: doc_id and number of ids of each document in it."""
    freq = freq.astype(np.uint64)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    n = len(ids)
    steps = -(-n // lanes)
    f_all, c_all = freq[ids], cum[ids]
    x = np.full(lanes, LOW, np.uint64)
    word, shift, low = np.uint64(32), np.uint64(bits), np.uint64(0xFFFFFFFF)
    room = np.uint64(63 - bits)
    out: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for step in range(steps - 1, -1, -1):
        f, c = f_all[step * lanes : (step + 1) * lanes], c_all[step * lanes : (step + 1) * lanes]
        own = x[: len(f)]
        full = own >= (f << room)
        if full.any():
            out.append((own[full] & low).astype("<u4"))
            written += len(out[-1])
            own[full] >>= word
        q = own // f
        own[:] = (q << shift) + (own - q * f) + c
        if step % every == 0:
            marks.append((written, x.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    parts = [_HEAD.pack(b"RANB", 2, bits, lanes, steps, every, len(docs), first, n, len(words), len(marks), table_crc)]
    parts += [struct.pack("<qI", *d) for d in docs]
    for done, state in reversed(marks):
        parts.append(struct.pack("<I", written - done) + state.astype("<u8").tobytes())
    parts.append(words.tobytes())
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


@lru_cache(maxsize=2)
def _slots(table: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    freq = np.frombuffer(table, "<u4").astype(np.uint64)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    return freq, cum, np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.uint32), freq.astype(np.int64))


def open_block(block: bytes) -> dict:
    """The parts of a block; ValueError where its checksum or magic does not hold."""
    if len(block) < _HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("a block's checksum does not hold")
    magic, version, bits, lanes, steps, every, n_docs, first, n, n_words, n_marks, table_crc = _HEAD.unpack_from(block)
    if magic != b"RANB" or version != 2:
        raise ValueError("not a block of this format")
    at = _HEAD.size
    docs = list(struct.iter_unpack("<qI", block[at : at + 12 * n_docs]))
    at += 12 * n_docs
    marks = []
    for _ in range(n_marks):
        marks.append((struct.unpack_from("<I", block, at)[0], np.frombuffer(block, "<u8", lanes, at + 4)))
        at += 4 + 8 * lanes
    return {"bits": bits, "lanes": lanes, "steps": steps, "every": every, "docs": docs, "first": first, "n": n, "table_crc": table_crc, "marks": marks, "words": np.frombuffer(block, "<u4", n_words, at)}


def decode_part(b: dict, k: int, table: bytes) -> np.ndarray:
    """The ids from checkpoint k to the next one; needs no other part."""
    freq, cum, symbol = _slots(table, b["bits"])
    lanes, begin = b["lanes"], k * b["every"]
    end = min(b["steps"], begin + b["every"])
    at, state = b["marks"][k]
    x, words = state.astype(np.uint64), b["words"]
    mask, shift, word = np.uint64((1 << b["bits"]) - 1), np.uint64(b["bits"]), np.uint64(32)
    low = np.uint64(LOW)
    out = np.empty(min(b["n"], end * lanes) - begin * lanes, symbol.dtype)
    for step in range(begin, end):
        own = x[: min(lanes, b["n"] - step * lanes)]
        slot = own & mask
        s = symbol[slot]
        own[:] = freq[s] * (own >> shift) + slot - cum[s]
        need = np.flatnonzero(own < low)
        if len(need):
            own[need] = (own[need] << word) | words[at : at + len(need)]
            at += len(need)
        out[(step - begin) * lanes : (step - begin) * lanes + len(s)] = s
    return out


def decode_block(block: bytes, table: bytes, table_crc: int = 0) -> tuple[dict, np.ndarray]:
    """A block's parts and ids. ValueError where it was written with another table."""
    b = open_block(block)
    if b["table_crc"] != table_crc:
        raise ValueError("a block was written with another table")
    parts = [decode_part(b, k, table) for k in range(len(b["marks"]))]
    return b, np.concatenate(parts) if parts else np.zeros(0, np.uint16)


# --- the tokenizer -------------------------------------------------------------------------------------------

#: Bytes of texts that are lower-cased and split alike by the library and by the rules below: white space, ASCII, and
#: letters of two bytes from À to ÿ. By kind: 1 letters, 2 digits, 3 marks, 4 white space; 0 for bytes of any other text.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[[*range(0x09, 0x0E), 0x20]] = 4
#: So many words, pre-tokens and bytes of either are kept beyond those of the run at hand; texts are read in runs of so many bytes.
_CACHE_WORDS, _CACHE_PARTS, _CACHE_CHARS = 300_000, 400_000, 8_000_000
_RUN_CHARS = 8 << 20


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _merges(path: str):
    """The vocabulary's model alone, which takes pre-tokens as they are spelt with spaces between them, and of each id
    whether it ends a pre-token."""
    from tokenizers import Tokenizer, pre_tokenizers

    bare = Tokenizer(_tokenizer(path).model)
    bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    last, mark = np.zeros(1 << 16, bool), bare.model.end_of_word_suffix
    last[[k for x, k in _tokenizer(path).get_vocab().items() if mark and x.endswith(mark)]] = True
    return bare, last


def _library_ids(path: str, text: str) -> np.ndarray:
    return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, "<u2")


def _spelling() -> np.ndarray:
    """The rule by which byte-level vocabularies write bytes as printable characters; spaces stay."""
    rest = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
    out = np.arange(256, dtype="<u4")
    out[rest] = 256 + np.arange(len(rest))
    out[0x20] = 0x20
    return out


_SPELL = _spelling()


def _part_ids(path: str, parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each pre-token has, and all of them; many go to the library in one call, which makes no object for
    each of their ids."""
    bare, last = _merges(path)
    lens, ids = [np.zeros(0, np.int64)], [np.zeros(0, "<u2")]
    ends = pa.array([*range(0, len(parts), 200), len(parts)], pa.int32())
    for some in pc.binary_join(pa.ListArray.from_arrays(ends, parts), " ").to_pylist():
        spelt = _SPELL[np.frombuffer(some.encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids.append(np.array(bare.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, "<u2"))
        lens.append(np.diff(np.flatnonzero(last[ids[-1]]), prepend=-1))
        if len(lens[-1]) != some.count(" ") + 1:  # a vocabulary that does not mark ends
            own = [[x.id for x in bare.model.tokenize(w)] for w in spelt.split(" ")]
            lens[-1], ids[-1] = np.array([len(x) for x in own]), np.array([x for w in own for x in w], "<u2")
    return np.concatenate(lens), np.concatenate(ids)


def _runs(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """So many values from each start on, one run after the other."""
    ends = np.cumsum(lens)
    out = np.empty(int(ends[-1]) if len(ends) else 0, values.dtype)
    k = begin = 0
    while k < len(lens):  # a bounded number of values at once
        to = max(k + 1, int(np.searchsorted(ends, begin + (1 << 20), "right")))
        end = int(ends[to - 1])
        out[begin:end] = values[np.repeat(starts[k:to] - ends[k:to] + lens[k:to], lens[k:to]) + np.arange(begin, end)]
        k, begin = to, end
    return out


class _Kept:
    """Ids by word, held as columns. Once words are too many only those that the run at hand asks for stay, so words that
    come often stay, and a long tail of rare ones takes bounded memory."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.string())
        self.starts, self.lens, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u2")

    def add(self, words: pa.StringArray, starts: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.starts, self.lens = np.concatenate([self.starts, starts + len(self.ids)]), np.concatenate([self.lens, lens])
        self.ids = np.concatenate([self.ids, ids])

    def places(self, words: pa.StringArray, most: int, learn: Callable[[pa.StringArray], None]) -> np.ndarray:
        """The place of each word (distinct ones); learn adds those that are new, in their order."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        if (has := at >= 0).all():
            return at
        new = words.filter(pa.array(~has))
        if len(self.words) + len(new) > most or self.words.nbytes + new.nbytes > _CACHE_CHARS:
            stay, at[has] = at[has], np.arange(has.sum())
            lens = self.lens[stay]
            self.words, self.ids = self.words.take(pa.array(stay)), _runs(self.ids, self.starts[stay], lens)
            self.starts, self.lens = np.cumsum(lens) - lens, lens
        at[~has] = len(self.words) + np.arange(len(new))
        learn(new)
        return at


_WORDS: dict[str, tuple[_Kept, _Kept]] = {}  # of each vocabulary: words between white space, and pre-tokens


def _learn(path: str, words: list[str], known: _Kept, parts: _Kept) -> None:
    """Adds the ids of words between white space. They are cut into pre-tokens (letters, a digit, marks), which go to the
    vocabulary's merges directly; words with an apostrophe or of special tokens go to the library."""
    raw = np.frombuffer("\n".join(words).lower().encode(), np.uint8)
    kind, hard = _KIND[raw], np.zeros(len(words), bool)
    word = np.cumsum(raw == 0x0A)
    hard[word[raw == ord("'")]] = True
    hard[word[:-1][(raw[:-1] == ord("<")) & (raw[1:] == ord("|"))]] = True
    kept = (raw != 0x0A) & ~hard[word]
    raw, kind, word = raw[kept], kind[kept], word[kept]
    first = np.flatnonzero((np.diff(kind, prepend=0) != 0) | (kind == 2) | (np.diff(word, prepend=-1) != 0))
    cut = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(raw)).astype("<i4")), pa.py_buffer(raw.tobytes())).dictionary_encode()

    def learn(new: pa.StringArray) -> None:
        lens, ids = _part_ids(path, new)
        parts.add(new, np.cumsum(lens) - lens, lens, ids)

    at = parts.places(cut.dictionary, _CACHE_PARTS, learn)[cut.indices.to_numpy()]
    ids = _runs(parts.ids, parts.starts[at], parts.lens[at])
    lens = np.bincount(word[first], parts.lens[at], len(words)).astype(np.int64)
    starts = np.cumsum(lens) - lens
    whole = [_library_ids(path, words[k]) for k in np.flatnonzero(hard)]
    lens[hard] = [len(x) for x in whole]
    starts[hard] = len(ids) + np.cumsum(lens[hard]) - lens[hard]
    known.add(pa.array(words, pa.string()), starts, lens, np.concatenate([ids, *whole]))


@lru_cache(maxsize=2)
def _ruled(path: str) -> bool:
    """Whether the rules above hold for this vocabulary: they are tried on each plain character beside letters, digits
    and itself. Where they do not, every text goes to the library whole."""
    if not all("<|" in x.content for x in _tokenizer(path).get_added_tokens_decoder().values()):
        return False
    every = [chr(k) for k in (*range(9, 14), *range(32, 127), *range(0xC0, 0x100)) if k not in (0xD7, 0xF7)]
    for text in [f"a{c}b A{c} {c}b {c}{c} 1{c}2 {c}'s it{c} the{c}, end" for c in every] + ["".join(every), " ".join(every), "Isn't IT the 'll <|endoftext|> A--b?! x,y.z"]:
        known = _Kept()
        _learn(path, text.split(), known, _Kept())
        if _runs(known.ids, known.starts, known.lens).tolist() != _library_ids(path, text).tolist():
            return False
    return True


def ids_of(path: str, text: str) -> bytes:
    """The ids of a whole text as the library gives them, as 16-bit integers."""
    return ids_of_texts(path, pa.array([text], pa.string()))[1].tobytes()


def ids_of_texts(path: str, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each text has, and all of them as 16-bit integers; each of their words is looked up once."""
    known, parts = _WORDS.setdefault(path, (_Kept(), _Kept()))
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, "<i4", len(texts) + 1, 4 * texts.offset)
    raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    odd = np.zeros(len(texts), bool)
    odd[np.searchsorted(ends[1:] - ends[0], np.flatnonzero(_KIND[raw] == 0), "right")] = True
    if not _ruled(path):
        odd[:] = True
    split = pc.ascii_split_whitespace(texts.filter(pa.array(~odd)))
    words = split.flatten().dictionary_encode()
    learn = lambda new: _learn(path, new.to_numpy(zero_copy_only=False).tolist(), known, parts)
    at = known.places(words.dictionary, _CACHE_WORDS, learn)[words.indices.to_numpy()]
    ids = _runs(known.ids, known.starts[at], known.lens[at])
    lens = np.zeros(len(texts), np.int64)
    lens[~odd] = np.diff(np.append(0, np.cumsum(known.lens[at]))[split.offsets.to_numpy()])
    if not odd.any():
        return lens, ids
    own = np.split(ids, np.cumsum(lens))
    for k, text in zip(np.flatnonzero(odd), texts.filter(pa.array(odd)).to_pylist()):
        own[k] = _library_ids(path, text)
        lens[k] = len(own[k])
    return lens, np.concatenate(own)


# --- the plan ------------------------------------------------------------------------------------------------

_TOKENS = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many bytes, but for the last."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in _gathered(batches, _RUN_CHARS):
            lens, ids = ids_of_texts(path, batch.column("text").cast(pa.string()))
            ends = np.append(0, np.cumsum(lens + 1))
            own = pa.py_buffer(np.insert(ids, np.cumsum(lens), end_id).tobytes())
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer((2 * ends).astype("<i4")), own])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lens), part, np.int32)), pa.array(start + ends[:-1]), batch.column("doc_id"), ids], schema=_TOKENS)
            start += int(ends[-1])

    return run


def _count(size: int):
    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u2"), minlength=size)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found], pa.int64())], names=["id", "n"])

    return run


_INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("first", pa.int64())])


def _write(folder: str, freq: np.ndarray, table_crc: int, block_ids: int, file_bytes: int):
    """Blocks of consecutive documents to files; a row for each block, once its file is closed."""

    def run(batches):
        held, docs, size, first, due = [], [], 0, 0, None
        sink, path, rows = None, "", []

        def put():
            nonlocal sink, path, held, docs, size
            if sink is None:
                path = f"{folder}/{uuid.uuid4().hex}.ranb"
                own, place = store(path)
                own.create_dir(place.rpartition("/")[0], recursive=True)
                sink = own.open_output_stream(place, compression=None)
            block = encode_block(np.concatenate(held), docs, first, freq, table_crc=table_crc)
            rows.append({"path": path, "offset": sum(r["length"] for r in rows), "length": len(block), "first": first})
            sink.write(block)
            held, docs, size = [], [], 0

        def closed():
            nonlocal sink, rows
            sink.close()
            sink, done, rows = None, rows, []
            return pa.RecordBatch.from_pylist(done, schema=_INDEX)

        for batch in batches:
            for at, doc_id, raw in zip(*(batch.column(c).to_pylist() for c in ("start", "doc_id", "ids"))):
                ids = np.frombuffer(raw, "<u2")
                if docs and (size >= block_ids or at != due):
                    put()
                    if rows[-1]["offset"] + rows[-1]["length"] >= file_bytes:
                        yield closed()
                if not docs:
                    first = at
                held.append(ids)
                docs.append((doc_id if doc_id is not None else NO_ID, len(ids)))
                size += len(ids)
                due = at + len(ids)
        if docs:
            put()
        if sink is not None:
            yield closed()

    return run


#: Stands for a null doc_id within a block.
NO_ID = -(1 << 63)


@lru_cache(maxsize=2)
def _shared_table(folder: str) -> tuple[bytes, int]:
    own, place = store(f"{folder}/table.rant")
    with own.open_input_stream(place, compression=None) as f:
        return open_table(f.read())


def _read(folder: str, digests: bool):
    def run(batches):
        table, crc = _shared_table(folder)
        for batch in batches:
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                own, place = store(path)
                with own.open_input_file(place) as f:
                    f.seek(offset)
                    raw = f.read(length)
                b, ids = decode_block(raw, table, crc)
                at, rows = 0, []
                for doc_id, n in b["docs"]:
                    doc = ids[at : at + n].astype("<u4")
                    rows.append((None if doc_id == NO_ID else doc_id, b["first"] + at, n, zlib.crc32(doc.tobytes()) if digests else doc.astype("<i4")))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64() if digests else pa.list_(pa.int32())))], names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 2, part_bytes: int = 24 << 20, block_ids: int = BLOCK_IDS, file_bytes: int = 64 << 20) -> str:
    """Encodes every whole text, appends end_id and writes all ids in ascending doc_id order to a new folder of token files;
    returns its path (by default one in spark.checkpoint.dir).

    A null text counts as empty and gives end_id alone; a null doc_id comes first; rows of one doc_id are ordered by
    XXH64 of their texts, and repeated rows are each written; other columns are left out; an empty table gives a folder
    without blocks. A document is never split over blocks. A task that is run again writes a file of a new name; only
    blocks that the index names are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    size = _tokenizer(tokenizer_path).get_vocab_size()
    if size > 1 << 16:
        raise ValueError("ids must fit 16 bits")
    own = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    parts = block_count(own, "text", part_bytes)
    order = ["doc_id", F.xxhash64("text")]
    tokens = staged(own.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_tokenise(tokenizer_path, end_id), "part int, start long, doc_id long, ids binary"), "tokens")
    counts = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(_count(size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]  # a row for each id of the vocabulary at most
    freq = frequency_table(counts)
    with open(tokenizer_path, "rb") as f:
        table = pack_table(freq, f.read())
    there, place = store(f"{folder}/table.rant")
    there.create_dir(place.rpartition("/")[0], recursive=True)
    with there.open_output_stream(place, compression=None) as f:
        f.write(table)
    last = tokens.groupBy("part").agg(F.max(F.col("start") + F.octet_length("ids") / 2).cast("long").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = last.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row for each part_bytes of text
    placed = tokens.join(F.broadcast(offsets), "part").select((F.col("start") + F.col("before")).alias("start"), "doc_id", "ids")
    placed.mapInArrow(_write(folder, freq, zlib.crc32(table[:-4]), block_ids, file_bytes), "path string, offset long, length long, first long").write.parquet(f"{folder}/index")
    return folder


def read_token_files(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """Per document of a folder of token files: doc_id, start (ids of all documents before it), n_tokens and its ids or
    their crc32. Each block is read and decoded by itself. ValueError for a block or table whose checksum does not hold
    and for a block of another table."""
    small_batches(spark, 16)
    index = spark.read.schema("path string, offset long, length long, first long").parquet(f"{folder}/index")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return index.repartitionByRange(n, "first").mapInArrow(_read(folder, digests), f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digests else 'ids array<int>'}")
