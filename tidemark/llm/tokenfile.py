"""Token ids in binary form, coded by a static range asymmetric numeral system (rANS).

Documents are laid out in doc_id order over range partitions. A partition cuts its stream of ids into
shards of whole documents. A shard is one self-contained container: a frequency table shared by all its
blocks, blocks of BLOCK ids that are coded independently with LANES interleaved states, checkpoints
(states and word offsets every SEGMENT steps, from which decoding can start), and a CRC-32 per block.
Decoding takes any shard alone, and all checkpoints of a shard at once.

Defined cases: null text is empty and has the end id only; a null doc_id comes first; repeated rows
are written each; ties in doc_id are ordered by a hash of the text; an empty table gives no shards and
no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, drop_at_exit, new_path, small, table, text_of

MAGIC, LANES, BLOCK, SEGMENT, SCALE = b"TRA1", 64, 1 << 15, 512, 18
LOW = np.uint64(1 << 31)
SHARD_IDS, END_ID = 1 << 21, 1
#: Pre-tokens that a worker remembers before it forgets the rarer ones; with SLICE, what bounds its memory.
REMEMBER, SLICE = 1_000_000, 16 << 20
TOKENIZER = "word_bpe_49k.json"
#: Words that Arrow can cut: ASCII without the apostrophe, and Latin-1 letters, which are lower-cased one to one.
PLAIN = "^[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: Their pre-tokens are runs of letters, single digits, and what lies between.
PARTS = "([a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9])"
LETTERS = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"


# the code


def table_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in use and their frequencies, at least 1 each, adding up to 2**SCALE."""
    count = np.bincount(ids)
    symbols = np.flatnonzero(count)
    total = 1 << SCALE
    if len(symbols) > total:
        raise ValueError("more symbols than the table has slots")
    freq = np.maximum(1, count[symbols] * total // max(1, count.sum()))
    over = int(freq.sum()) - total
    if over < 0:
        freq[freq.argmax()] -= over
    while over > 0:  # many rare symbols were raised to 1: take it from the common ones
        room = np.minimum(freq - 1, np.maximum(1, freq * over // total + 1))
        take = np.minimum(room, np.maximum(0, over - (np.cumsum(room) - room)))
        freq, over = freq - take, over - int(take.sum())
    return symbols.astype(np.uint32), freq.astype(np.uint32)


def push(at: np.ndarray, freq: np.ndarray, start: np.ndarray):
    """Code symbols at[blocks, steps, lanes] backwards. Returns the words by block, their count per step, and states at checkpoints."""
    blocks, steps, lanes = at.shape
    x = np.full((blocks, lanes), LOW, np.uint64)
    words, full = np.empty(at.shape, np.uint32), np.empty(at.shape, bool)
    states = np.empty((blocks, -(-steps // SEGMENT), lanes), np.uint64)
    f64, c64 = freq.astype(np.uint64), start.astype(np.uint64)
    for t in range(steps - 1, -1, -1):
        s = at[:, t]
        f = f64[s]
        out = x >= f << np.uint64(63 - SCALE)
        words[:, t], full[:, t] = x.astype(np.uint32), out
        x = np.where(out, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + c64[s]
        if t % SEGMENT == 0:
            states[:, t // SEGMENT] = x
    return words[full], full.sum(axis=2), states


def pull(states: np.ndarray, offset: np.ndarray, steps: int, words: np.ndarray, freq: np.ndarray, start: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Decode `steps` steps from every checkpoint at once: symbol indices [checkpoints, steps, lanes]."""
    x, at = states.copy(), offset.astype(np.int64)
    out = np.empty((len(states), steps, states.shape[1]), np.int32)
    f64, c64, mask = freq.astype(np.uint64), start.astype(np.uint64), np.uint64((1 << SCALE) - 1)
    words = np.append(words, np.uint32(0))
    for t in range(steps):
        low = x & mask
        s = slot[low]
        out[:, t] = s
        x = f64[s] * (x >> np.uint64(SCALE)) + low - c64[s]
        need = x < LOW
        rank = np.cumsum(need, axis=1)
        read = words[np.minimum(at[:, None] + rank - 1, len(words) - 1)]
        x = np.where(need, x << np.uint64(32) | read, x)
        at += rank[:, -1]
    return out


def pack(ids: np.ndarray, extra: dict) -> bytes:
    """One container of ids. extra: what else its header holds."""
    symbols, freq = table_of(ids) if len(ids) else (np.zeros(0, np.uint32), np.zeros(0, np.uint32))
    start = np.cumsum(freq) - freq
    index = np.zeros(int(symbols[-1]) + 1 if len(ids) else 0, np.int32)
    index[symbols] = np.arange(len(symbols))
    index = index[ids]
    whole = len(ids) // BLOCK
    groups, words, states, offsets, done = [], [], [], [], 0
    rest = index[whole * BLOCK :]
    if whole:
        groups.append(index[: whole * BLOCK].reshape(whole, BLOCK // LANES, LANES))
    if len(rest):
        groups.append(np.pad(rest, (0, -len(rest) % LANES), constant_values=int(freq.argmax())).reshape(1, -1, LANES))
    for g in groups:
        w, per_step, st = push(g, freq, start)
        upto = np.cumsum(per_step.ravel()) - per_step.ravel()
        offsets.append(done + upto.reshape(per_step.shape)[:, ::SEGMENT].ravel())
        words.append(w), states.append(st.reshape(-1, LANES))
        done += len(w)
    crc = np.array([zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)], np.uint32)
    parts = [zlib.compress(symbols.astype("<u4").tobytes(), 1), zlib.compress(freq.astype("<u4").tobytes(), 1), crc.astype("<u4").tobytes()]
    parts += [np.concatenate(x).astype(k).tobytes() if x else b"" for x, k in ((states, "<u8"), (offsets, "<u8"), (words, "<u4"))]
    head = zlib.compress(json.dumps(extra | {"n": len(ids), "lanes": LANES, "block": BLOCK, "segment": SEGMENT, "scale": SCALE, "parts": [len(p) for p in parts]}).encode(), 1)
    return MAGIC + struct.pack("<II", len(head), zlib.crc32(head)) + head + b"".join(parts)


def header(data: bytes) -> tuple[dict, list[memoryview]]:
    size, crc = struct.unpack_from("<II", data, 4)
    head = data[12 : 12 + size]
    if data[:4] != MAGIC or zlib.crc32(head) != crc:
        raise ValueError("not a token container, or its header is damaged")
    info, at, parts = json.loads(zlib.decompress(head)), 12 + size, []
    for n in info["parts"]:
        parts.append(memoryview(data)[at : at + n])
        at += n
    return info, parts


def unpack(data: bytes, first_block: int = 0, blocks: int | None = None) -> np.ndarray:
    """The ids of a container, or of some of its blocks. Raises if a checksum is wrong."""
    info, parts = header(data)
    n, block, lanes, segment = info["n"], info["block"], info["lanes"], info["segment"]
    symbols, freq = (np.frombuffer(zlib.decompress(p), "<u4") for p in parts[:2])
    crc, states, offset, words = (np.frombuffer(p, k) for p, k in zip(parts[2:], ("<u4", "<u8", "<u8", "<u4"), strict=True))
    if not n:
        return np.zeros(0, np.uint32)
    states = states.reshape(-1, lanes)
    start, slot = np.cumsum(freq) - freq, np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    steps, last = block // lanes, -(-(n % block) // lanes)
    lengths = [segment] * (n // block * (steps // segment)) + [min(segment, last - i) for i in range(0, last, segment)]
    per = steps // segment
    stop = len(crc) if blocks is None else min(len(crc), first_block + blocks)
    lo, hi = first_block * per, min(stop * per, len(lengths))
    full = hi - lo - (1 if hi > lo and lengths[hi - 1] < segment else 0)
    out = []
    if full:
        out.append(pull(states[lo : lo + full], offset[lo : lo + full], segment, words, freq, start, slot).ravel())
    if lo + full < hi:
        out.append(pull(states[hi - 1 : hi], offset[hi - 1 : hi], lengths[hi - 1], words, freq, start, slot).ravel())
    ids = symbols[np.concatenate(out)[: min(n, stop * block) - first_block * block]]
    for k in range(first_block, stop):
        if zlib.crc32(ids[(k - first_block) * block : (k - first_block + 1) * block].astype("<u4").tobytes()) != crc[k]:
            raise ValueError(f"block {k} is damaged")
    return ids


# tokens


class Encoder:
    """Ids of texts by a public tokenizer, looked up by pre-token: no token crosses ASCII white space, and a
    word's ids are those of its pre-tokens in order. Each is encoded by the library once and remembered.

    Words of ASCII and Latin-1 letters, digits and marks are lower-cased and cut into pre-tokens by Arrow, a
    batch's distinct words at once; any other word is one entry, encoded as it stands. New pre-tokens of letters
    are encoded together, joined by spaces, and taken apart where a token has the end-of-word mark.

    What is remembered is an Arrow array of words beside their ids. When there are too many, those met since
    the last time stay (or, if these are too many, those of the last batch), so what is common is kept however
    many words there are."""

    def __init__(self, path: str, end_id: int, remember: int = REMEMBER):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.remember = Tokenizer.from_file(path), remember
        self.end = np.array([end_id], np.uint32)
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        mark = json.loads(self.tokenizer.model.__getstate__())["end_of_word_suffix"]
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.closes[i] = bool(mark) and token.endswith(mark)
        self.words, self.bank, self.sizes, self.met = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)

    def learn(self, words: pa.Array) -> np.ndarray:
        """Remember the ids of new pre-tokens and words, and return their places."""
        plain = np.asarray(pc.match_substring_regex(words, LETTERS))
        joined, rest = words.filter(pa.array(plain)), words.filter(pa.array(~plain))
        ids, sizes = [self.bank], [self.sizes]
        for i in range(0, len(joined), 20_000):
            some = joined.slice(i, 20_000).to_pylist()
            found = np.array(self.letters.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[found]) + 1
            if len(ends) != len(some):
                raise ValueError("words and their last tokens don't match")
            ids.append(found), sizes.append(np.diff(ends, prepend=0))
        for i in range(0, len(rest), 4096):
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(rest.slice(i, 4096).to_pylist(), add_special_tokens=False)]
            ids.append(np.array([x for w in coded for x in w], np.uint32)), sizes.append(np.fromiter(map(len, coded), np.int64))
        self.words, self.bank, self.sizes = pa.concat_arrays([self.words, joined, rest]), np.concatenate(ids), np.concatenate(sizes)
        at = np.empty(len(words), np.int64)
        at[np.append(np.flatnonzero(plain), np.flatnonzero(~plain))] = np.arange(len(self.met), len(self.met) + len(words))
        self.met = np.append(self.met, np.ones(len(words), bool))
        return at

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The places of distinct words in what is remembered; new ones are learned."""
        at = np.array(pc.fill_null(pc.index_in(words, value_set=self.words), -1), np.int64)
        new = at < 0
        if new.any():
            at[new] = self.learn(words.filter(pa.array(new)))
        self.met[at] = True
        return at

    def sweep(self, last: np.ndarray) -> None:
        """Forget what was not met since the last time, or what the last batch did not have."""
        if len(self.words) > self.remember:
            if 2 * self.met.sum() > self.remember:
                self.met[:] = False
                self.met[last] = True
            keep = np.flatnonzero(self.met)
            self.words = self.words.take(pa.array(keep))
            self.bank, self.sizes = joined_up(self.bank, self.sizes, keep)
            self.met = np.zeros(len(keep), bool)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch, each text's followed by the end id, and the number of ids of each text."""
        words = pc.ascii_split_whitespace(texts.cast(pa.string()))
        flat = words.flatten().dictionary_encode()
        plain = pc.and_(pc.match_substring_regex(flat.dictionary, PLAIN), pc.invert(pc.match_substring(flat.dictionary, "<|")))
        spaced = pc.replace_substring_regex(pc.utf8_lower(flat.dictionary), PARTS, r" \1 ")
        parts = pc.ascii_split_whitespace(pc.if_else(plain, spaced, flat.dictionary))
        entry = parts.flatten().dictionary_encode()
        at = self.numbers(entry.dictionary)
        bank, sizes = joined_up(self.bank, self.sizes, at[np.asarray(entry.indices)])
        self.sweep(at)
        upto = np.append(0, np.cumsum(sizes))[np.asarray(parts.offsets)]
        bank, sizes = np.append(bank, self.end), np.append(np.diff(upto), 1)  # the last entry is the end id
        ends = np.asarray(words.offsets)[1:] - words.offsets[0].as_py()
        code = np.insert(np.asarray(flat.indices), ends, len(sizes) - 1)
        out, per = joined_up(bank, sizes, code)
        closing = np.cumsum(per)[ends + np.arange(len(ends))] if len(ends) else np.zeros(0, np.int64)
        return out, np.diff(closing, prepend=0)


def joined_up(bank: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries numbered by code, one behind the other, and their sizes; entry k of bank is sizes[k] long."""
    if not len(code):
        return bank[:0], np.zeros(0, np.int64)
    per = sizes[code]
    upto = np.cumsum(per)
    at = np.repeat((np.cumsum(sizes) - sizes)[code] - (upto - per), per)
    at += np.arange(len(at))
    return bank[at], per


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder a worker, so that what it remembers outlives a task."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def sliced(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches of rows (doc_id, text, ...) of at most `most` bytes of text, or of a single row."""
    for batch in batches:
        upto, at = np.cumsum(np.asarray(pc.binary_length(batch.column(1)), np.int64)), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_ids: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows (shard, first, n, container) of one partition's documents in their order; first counts from the partition's start."""
    encode, docs, counts, ids, held, shard, first = encoder(path, end_id), [], [], [], 0, 0, 0

    def close():
        data = pack(np.concatenate(ids), {"docs": docs, "counts": counts})
        return shard, first, held, data

    for batch in sliced(batches):
        found, sizes = encode(batch.column(1))
        at = 0
        for doc, n in zip(batch.column(0).to_pylist(), sizes.tolist(), strict=True):
            if held and held + n > shard_ids:
                yield close()
                shard, first, docs, counts, ids, held = shard + 1, first + held, [], [], [], 0
            docs.append(doc), counts.append(n), ids.append(found[at : at + n])
            at, held = at + n, held + n
    if held:
        yield close()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode docs (doc_id, text) in doc_id order into containers under path. Texts are shuffled once."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            break
        else:
            return
        part = batch.column(2)[0].as_py()

        def rest():
            yield batch
            yield from batches

        for shard, first, n, data in shards(rest(), tokenizer, end_id, shard_ids):
            yield pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "first": [first], "n": [n], "container": pa.array([data], pa.binary())})

    rows = docs.select("doc_id", text_of().alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = rows.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    rows.mapInArrow(run, "part long, shard long, first long, n long, container binary").write.option("compression", "none").parquet(path)


def read(spark, path: str, id_type: str = "bigint") -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of the documents in the containers under path.

    Starts are prefix sums: inside shards and partitions when written or decoded, over partitions here,
    one row a partition."""
    files = spark.read.parquet(path)

    def run(batches):
        for batch in batches:
            for part, first, data in zip(batch["part"], batch["first"], batch["container"], strict=True):
                info, _ = header(data)
                ids, ends = unpack(data), np.cumsum(info["counts"])
                starts = ends - info["counts"]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pd.DataFrame({"doc_id": pd.Series(info["docs"], dtype=object), "part": part, "inside": first + starts, "n_tokens": info["counts"], "ids_crc32": crc})

    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    offsets = parts.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    per_doc = files.select("part", "first", "container").mapInPandas(run, f"doc_id {id_type}, part long, inside long, n_tokens long, ids_crc32 long")
    joined = per_doc.join(small(offsets, parts.count()), F.col("part") == F.col("p"))
    return joined.select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir, tokenizer: str | None = None):
    """op8: every document's place, length and checksum, read back from the files."""
    import public_tokenizers

    path = new_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path(TOKENIZER))
    drop_at_exit(spark, path)
    return read(spark, path)
