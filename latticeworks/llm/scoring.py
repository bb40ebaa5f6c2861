"""Language-model scores of documents: a unigram base and the context mixing model of ``mixmodel``.

A text is a sequence of tokens, its words and one end. The commonest tokens, those that take at least one in LISTED of
all training tokens, have a prefix code; all others escape and are spelled byte by byte. Every decision of a path is
mixed from predictors that look across the token's border: at the word before, its last three bytes, its last byte, and
at nothing. Spellings are mixed from predictors of the bytes before. At last the score adapts to the document: each
token's probability is drawn towards its share of the text so far, at several rates, mixed by how well each has done.

Chunks of text are coded once against their own token lists, in order of the tokens' hashes. Token lists, with training
counts, meet in ranges of that hash: counts are added there, rare tokens learn to be spelled and are scored. Pairs
(word before, token), each once a chunk, meet in ranges of the first one's hash, where the mixer learns from their counts
and scores each different pair once. Both answers return to their chunk and are added up along the documents.

Scale: what is gathered (token lists, pairs) grows with the corpus, as do the ranges, so that a range stays of one size;
it travels packed, about five bytes a pair. A frequent word has one run of pairs a chunk, of bounded length. Broadcast is
the list of coded tokens, LISTED at most. How many ranges there are follows from the table alone, and every sum is over
integers or in one order, so scores don't depend on cores, partitions or chunks. Memory is bounded by a chunk (about 24
MB of text, or one document) and by a range.

Defined results: a null or empty text is the end token alone; a null ``doc_id`` counts as empty text for the fold and
is carried through; repeated rows are documents of their own; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.llm import mixmodel as M
from latticeworks.llm._store import materialize
from latticeworks.llm._text import give_back, per_doc, text_slices, words_of

CHUNK_BYTES = 24 << 20
FOLDS, HELD_OUT = 7, 2
END = "\n"
#: Tokens with a code take at least one in so many training tokens, and are seen so often at least.
LISTED, LEAST = 1 << 16, 4
#: Different tokens in a range, tokens whose pairs make a range, and tokens of all chunks that a range of tokens takes.
RANGE_TYPES, RANGE_PAIRS, RANGE_TOKENS = 1 << 17, 1 << 21, 1 << 26
#: One in so many token hashes estimates how many different tokens there are.
SAMPLE = 256
#: Tokens of the model's opinion that weigh against the text so far.
RATES = (100.0, 1000.0, 10000.0)
_U = np.uint64
_START = np.iinfo(np.uint64).max
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
_CODED = "chunk long, doc_ids array<long>, words binary, bytes binary, ids binary, end long, tokens binary, sizes binary, train binary, n_train long, n_all long, sample array<long>"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def pack(x: np.ndarray | bytes) -> bytes:
    """Compressed; of numbers first all lowest bytes, then all second ones, and so on."""
    raw = x if isinstance(x, bytes) else np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(x: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(unpack_bytes(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).ravel().view(kind)


def unpack_bytes(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _batch(schema: str, **columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[t]) if n in columns else pa.nulls(rows, kinds[t]) for n, t in zip(names, types, strict=True)], names=list(names))


def _tokens(data: bytes, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _hashes(tokens: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t) for t in tokens.cast(pa.large_binary()).to_pylist()), _U, len(tokens))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows joined until they hold about CHUNK_BYTES of text."""
    held, size = [], 0
    for part in text_slices(batches):
        held.append(part)
        size += part.nbytes
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def coded(docs: DataFrame) -> DataFrame:
    """A row for each chunk: its documents with their words as indexes into the chunk's tokens, and the tokens in order of their hashes with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for chunk in chunks(batches):
            words = words_of(chunk.column("text"), lower=True)
            doc_ids = chunk.column("doc_id").to_pylist()
            train = ~np.array([held_out(d) for d in doc_ids], bool)
            tokens = pa.concat_arrays([words.vocab.cast(pa.large_binary()), pa.array([END.encode()], pa.large_binary())])
            keys = _hashes(tokens)
            order = np.argsort(keys, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            counts = np.append(np.bincount(words.ids[train[words.doc]], minlength=len(words.vocab)), train.sum()).astype("<i8")
            sizes = pc.binary_length(tokens).to_numpy(zero_copy_only=False).astype("<i4")
            n_bytes = per_doc(sizes[words.ids] + 1, words.offsets) + 1
            tokens = tokens.take(pa.array(order))
            yield _batch(
                _CODED, chunk=[number], doc_ids=[doc_ids], words=[pack(words.counts.astype("<i4"))], bytes=[pack(n_bytes.astype("<i8"))], ids=[pack(place[words.ids])], end=[int(place[-1])],
                tokens=[pack(b"".join(tokens.to_pylist()))], sizes=[pack(sizes[order])], train=[pack(counts[order])], n_train=[int(counts.sum())], n_all=[len(words.ids) + len(doc_ids)],
                sample=[keys[keys % _U(SAMPLE) == 0].view(np.int64).tolist()],
            )
            number += 1

    return docs.select("doc_id", "text").mapInArrow(run, _CODED)


def _cuts(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of the ranges that sorted 64-bit keys fall in; equal widths."""
    # The upper 32 bits are enough to find a range, and keep the product in 64 bits.
    own = ((keys >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return list(zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))


# --- tokens --------------------------------------------------------------------------------------------------------

_LISTS = "part long, chunk long, tokens binary, sizes binary, train binary"
_RATED = "chunk long, part long, counts binary, spelled binary, keys binary, token binary, count long, types long"


def _lists(both: DataFrame, ranges: int) -> DataFrame:
    """The chunks' token lists, cut into ranges of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data, sizes, train in zip(*(batch.column(c).to_pylist() for c in ("chunk", "tokens", "sizes", "train")), strict=True):
                data, sizes, train = unpack_bytes(data), unpack(sizes, "<i4"), unpack(train, "<i8")
                at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                cut = _cuts(_hashes(_tokens(data, sizes)), ranges)
                yield _batch(_LISTS, part=[r for r, _, _ in cut], chunk=[chunk] * len(cut), tokens=[pack(data[at[a] : at[b]]) for _, a, b in cut], sizes=[pack(sizes[a:b]) for _, a, b in cut], train=[pack(train[a:b]) for _, a, b in cut])

    return both.select("chunk", "tokens", "sizes", "train").mapInArrow(run, _LISTS)


def _rated(lists: DataFrame, least: int) -> DataFrame:
    """For each list its training counts, log10 of the spelling of tokens without a code (1 for those with one) and the hashes of those with one; once a range the tokens with a code, and the number of different training tokens."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["part", "chunk", "tokens", "sizes", "train"]).to_pylist()
        sizes = [unpack(x["sizes"], "<i4") for x in rows]
        tokens = _tokens(b"".join(unpack_bytes(x["tokens"]) for x in rows), np.concatenate(sizes)).dictionary_encode()
        own, names = tokens.indices.to_numpy(), tokens.dictionary
        count = added(own, np.concatenate([unpack(x["train"], "<i8") for x in rows]), len(names))
        has_code = (count >= least) | pc.equal(names, pa.scalar(END.encode(), pa.large_binary())).to_numpy(zero_copy_only=False)
        spelled = np.ones(len(names), np.float32)
        spelled[~has_code] = M.log10_spellings(names.filter(pa.array(~has_code)), count[~has_code])
        keys = np.zeros(len(names), _U)
        keys[has_code] = _hashes(names.filter(pa.array(has_code)))
        cut = np.split(own, np.cumsum([len(x) for x in sizes])[:-1])
        answers = _batch(_RATED, chunk=[x["chunk"] for x in rows], part=[x["part"] for x in rows], counts=[pack(count[i]) for i in cut], spelled=[pack(spelled[i]) for i in cut], keys=[pack(keys[i][has_code[i]]) for i in cut])
        listed = np.flatnonzero(has_code)
        codes = _batch(_RATED, token=names.take(pa.array(listed)).to_pylist(), count=count[listed].tolist())
        total = _batch(_RATED, types=[int((count > 0).sum())])
        give_back()
        return pa.Table.from_batches([answers, codes, total])

    return lists.groupBy("part").applyInArrow(run, _RATED)


def added(own: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit counts by number, exact whatever their size."""
    out = np.zeros(n, np.int64)
    np.add.at(out, own, count)
    return out


class Codes:
    """The tokens with a code and the escape, as symbols in order of their paths: bounded, whatever the corpus."""

    def __init__(self, counts: dict[bytes, int], n_train: int):
        keyed = sorted((xxhash.xxh64_intdigest(t), c) for t, c in counts.items())
        mass = np.array([*(max(1, c) for _, c in keyed), max(1, n_train - sum(c for _, c in keyed))], np.int64)
        code, length, self.width = M.huffman(mass.tolist())
        order = np.argsort(code)
        self.code, self.length, self.mass = code[order], length[order], mass[order]
        symbol = np.argsort(order)
        self.keys, self.symbols, self.escape = np.array([k for k, _ in keyed], _U), symbol[:-1], int(symbol[-1])

    def __len__(self) -> int:
        return len(self.mass)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Symbols of tokens that have a code, by their hashes."""
        return self.symbols[np.searchsorted(self.keys, keys)]


# --- pairs ---------------------------------------------------------------------------------------------------------

_PAIRS = "part long, chunk long, before binary, tails binary, runs binary, symbols binary, train binary"
_SCORED = "chunk long, part long, pairs binary"


class Chunk:
    """The tokens of a chunk in order, each document's end included, and the different pairs (word before, symbol) among them."""

    def __init__(self, row: dict, answers: list[dict], codes: Codes):
        answers = sorted((x for x in answers if x["counts"] is not None), key=lambda x: x["part"])
        self.counts, spelled, keys = (np.concatenate([unpack(x[c], k) for x in answers]) for c, k in (("counts", "<i8"), ("spelled", "<f4"), ("keys", "<u8")))
        symbols = np.full(len(self.counts), codes.escape, np.int64)
        symbols[spelled > 0] = codes.find(keys)
        self.spelled = np.where(spelled > 0, 0, spelled).astype(np.float64)
        self.doc_ids, words = row["doc_ids"], unpack(row["words"], "<i4").astype(np.int64)
        self.n = words + 1
        self.starts = np.cumsum(self.n) - self.n
        last = np.zeros(int(self.n.sum()), bool)
        last[self.starts + words] = True
        self.ids = np.full(len(last), row["end"], np.int64)
        self.ids[~last] = unpack(row["ids"], "<i4")
        before = np.concatenate([self.ids[:1], self.ids[:-1]])
        before[self.starts] = len(symbols)  # a place of its own before each document
        self.pairs, self.pair = np.unique(before * len(codes) + symbols[self.ids], return_inverse=True)


def _pairs(coded_rows: DataFrame, answers: DataFrame, codes, ranges: int) -> DataFrame:
    """The chunks' different pairs with their training counts, cut into ranges of the hash of the word before."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, own = left.to_pylist()[0], codes.value
        chunk = Chunk(row, right.to_pylist(), own)
        train = np.repeat(~np.array([held_out(d) for d in chunk.doc_ids], bool), chunk.n)
        count = np.bincount(chunk.pair[train], minlength=len(chunk.pairs)).astype("<i8")
        before, symbol = np.divmod(chunk.pairs, len(own))
        first = np.flatnonzero(np.diff(before, prepend=-1))
        data, sizes = unpack_bytes(row["tokens"]), unpack(row["sizes"], "<i4")
        keys, tails = np.append(_hashes(_tokens(data, sizes)), _U(_START))[before[first]], np.append(_tails(data, sizes), 0)[before[first]]
        cut = _cuts(keys, ranges)
        edges = np.append(first, len(before))
        runs = np.diff(edges).astype("<i4")
        part = lambda x: [pack(x[edges[a] : edges[b]]) for _, a, b in cut]
        return pa.Table.from_batches([_batch(
            _PAIRS, part=[r for r, _, _ in cut], chunk=[row["chunk"]] * len(cut), before=[pack(keys[a:b]) for _, a, b in cut], tails=[pack(tails[a:b].astype("<i4")) for _, a, b in cut],
            runs=[pack(runs[a:b]) for _, a, b in cut], symbols=part(symbol.astype("<i4")), train=part(count),
        )])

    left = coded_rows.select("chunk", "doc_ids", "words", "ids", "end", "tokens", "sizes")
    return left.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, _PAIRS)


def _tails(data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The last three bytes of each token as one number, spaces before shorter ones."""
    flat = np.frombuffer(b"   " + data, np.uint8).astype(np.int64)
    ends = np.cumsum(sizes, dtype=np.int64) + 3
    out = np.zeros(len(sizes), np.int64)
    for k in (3, 2, 1):
        out = out << 8 | np.where(sizes >= k, flat[ends - k], 32)
    return out


def _scored(pairs: DataFrame, codes) -> DataFrame:
    """For each run of pairs the log10 of their symbols, from the counts of all chunks."""

    def run(table: pa.Table) -> pa.Table:
        rows, own = table.to_pylist(), codes.value
        keys, tails, runs, symbols, train = (np.concatenate([unpack(x[c], k) for x in rows]) for c, k in (("before", "<u8"), ("tails", "<i4"), ("runs", "<i4"), ("symbols", "<i4"), ("train", "<i8")))
        _, first, word = np.unique(keys, return_index=True, return_inverse=True)
        different, row = np.unique(np.repeat(word, runs) * len(own) + symbols, return_inverse=True)
        count = added(row, train, len(different))
        word, symbol = np.divmod(different, len(own))
        tail = tails[first][word]
        code, length = own.code[symbol], own.length[symbol]
        predictors = [
            M.Shared(symbol, own.code, own.length, own.mass, own.width), M.Counts(tail & 0xFF, code, count, own.width),
            M.Counts(tail, code, count, own.width, M.SECOND_EDGES), M.Counts(word, code, count, own.width, M.FIRST_EDGES, sorted=True),
        ]
        logs = M.log10_paths(predictors, code, length, count, own.width).astype("<f4")[row]
        sizes = [len(unpack(x["symbols"], "<i4")) for x in rows]
        cut = np.split(logs, np.cumsum(sizes)[:-1])
        del predictors, different, row, count, word, symbol, tail, code, length
        give_back()
        return pa.Table.from_batches([_batch(_SCORED, chunk=[x["chunk"] for x in rows], part=[x["part"] for x in rows], pairs=[pack(x) for x in cut])])

    return pairs.groupBy("part").applyInArrow(run, _SCORED)


# --- documents -----------------------------------------------------------------------------------------------------


def adapted(logs: np.ndarray, tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 of each document of ``n`` tokens, whose own ones have probabilities 10**logs: each rate draws them towards the token's share of the document so far, and a document is the mixture of what all rates, and none, make of it."""
    starts = np.cumsum(n) - n
    place = np.arange(len(logs)) - np.repeat(starts, n)
    key = np.repeat(np.arange(len(n)), n) * (int(tokens.max(initial=0)) + 1) + tokens
    order = np.argsort(key, kind="stable")
    new = np.diff(key[order], prepend=-1) != 0
    seen = np.empty(len(logs), np.int64)
    seen[order] = np.arange(len(logs)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    again = np.flatnonzero(seen)
    own, seen, far = 10.0 ** logs[again], seen[again], np.arange(int(n.max(initial=0)))
    sums = [np.add.reduceat(logs, starts)]
    for rate in RATES:
        now = logs + np.log10(rate / (far + rate))[place]
        now[again] = np.log10((seen + rate * own) / (place[again] + rate))
        sums.append(np.add.reduceat(now, starts))
    best = np.max(sums, axis=0)
    return best + np.log10(np.mean(10 ** (np.array(sums) - best), axis=0))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every document."""
    spark = docs.sparkSession
    both = materialize(coded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "lm-coded", "uncompressed")
    n_train, n_all = (x or 0 for x in both.agg(F.sum("n_train"), F.sum("n_all")).first())
    n_types = both.select(F.explode("sample").alias("key")).distinct().count() * SAMPLE
    least = max(LEAST, -(-n_train // LISTED))
    rated = _rated(_lists(both, max(1, -(-n_types // RANGE_TYPES), -(-n_all // RANGE_TOKENS))), least)
    rated = materialize(rated, "lm-tokens", "uncompressed")
    found = rated.where("token is not null").select("token", "count").collect()  # LISTED rows at most, and the end
    known = rated.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    codes = spark.sparkContext.broadcast(Codes({bytes(x.token): x["count"] for x in found} or {END.encode(): 1}, n_train))
    answers = rated.where("chunk is not null").select("chunk", "part", "counts", "spelled", "keys")
    pairs = _scored(_pairs(both, answers, codes, max(1, -(-n_all // RANGE_PAIRS))), codes)
    answers = answers.withColumn("pairs", F.lit(None).cast("binary")).unionByName(pairs, allowMissingColumns=True)
    smoothed = float(n_train + known + 1)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        row, given = left.to_pylist()[0], right.to_pylist()
        chunk = Chunk(row, given, codes.value)
        logs = np.concatenate([unpack(x["pairs"], "<f4") for x in sorted((x for x in given if x["pairs"] is not None), key=lambda x: x["part"])])
        mixed = adapted(logs[chunk.pair].astype(np.float64) + chunk.spelled[chunk.ids], chunk.ids, chunk.n)
        total = lambda x: np.add.reduceat(x[chunk.ids], chunk.starts)
        n_bytes = unpack(row["bytes"], "<i8")
        columns = [chunk.doc_ids, [held_out(d) for d in chunk.doc_ids], chunk.n, total((chunk.counts > 0).astype(np.int64)), np.full(len(chunk.n), n_train, np.int64), total(np.log10((chunk.counts + 1) / smoothed)), mixed, n_bytes, -mixed / np.log10(2.0) / n_bytes]
        return pa.Table.from_batches([_batch(_OUT, **dict(zip((c.split()[0] for c in _OUT.split(", ")), columns, strict=True)))])

    return both.select("chunk", "doc_ids", "words", "bytes", "ids", "end").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add, _OUT)
