"""Language-model scoring with a hierarchical Pitman-Yor model.

Every word has a restaurant over the words that follow it (so has the start of a text); all share one parent
restaurant, whose base is uniform over the known words and one unknown word. Seating is sampled by Gibbs: in a sweep
each dish of each restaurant gets up and is seated anew, customer after customer, where the i-th opens a table with
probability a / (a + i - discount * tables), a being the restaurant's pull towards a new table times the parent's
probability of the dish without the dish's own tables. seat() takes customers in blocks of 1/64 of those who sit
already, at least one; the rule is the same at every size. Tables of the contexts are the parent's customers. The
predictive probabilities are averaged over the samples kept after burn-in.

Texts are dealt into chunks by a hash of the row. A chunk sends each bucket of contexts its distinct (context, word)
pairs with their training counts, and a bucket keeps the pairs of its contexts. Contexts that a sample of the texts
shows to be frequent are split over buckets by the word; that routes rows and changes no result. Sums over a split
context go through the driver, at most a few figures a bucket. Each sweep exchanges exact totals: buckets of contexts
tell buckets of words the new tables of the dishes that can change, those with two or more customers; buckets of words
seat the parent and answer; the parent's two totals go through the driver. Draws depend on hashes of the words and the
sweep alone, so scores are the same for any number of chunks and buckets. Probabilities over the known words and the
unknown one add up to one. Nothing that grows with the corpus is broadcast or collected but the split contexts, of
which there are at most two a bucket.

Edge cases: a null or empty text is one end token. Without training rows, all words are unknown. A null id counts
as an empty text for the split. Repeated rows train and score once each; they share a chunk. Very long texts are read
whole. An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.llm.common import Scratch, delete_folder, shuffle_partitions, text_or_empty, words

END = b" "  # no word holds a space
START = 0x9E3779B97F4A7C15  # the context of a text's first token, in the place of a word's hash
CHUNK_BYTES = 4 << 20
#: Bytes of text whose pairs a bucket gets about.
BUCKET_BYTES = 12 << 20
#: Bytes of text that are read for each bucket, and at least, to find the contexts to split.
SAMPLE_A_BUCKET, SAMPLE_LEAST = 8 << 10, 16 << 20
BURN_IN, SAMPLES = 3, 3
#: Shares of the buckets that are shuffled one after the other.
ROUNDS = 4
#: Groups that a task takes one after the other if the usual partitions are too few. Each task's table is a file, and a small one costs as much as a large one.
GROUPS_A_TASK = 8
#: (discount, strength) of the context restaurants and of their parent.
CONTEXT, PARENT = (0.8, 5.0), (0.8, 20.0)
SEED = 42
ZSTD = pa.Codec("zstd", 1)
#: Kinds of rows between the steps.
PAIRS, CHUNK, SEATING, NAMES, TABLES, ROOT, SHARED, REPLY, FOUND = range(9)
ROWS = "to long, kind int, sender long, parts array<binary>, figures array<double>"
SCHEMA = pa.schema([("to", pa.int64()), ("kind", pa.int32()), ("sender", pa.int64()), ("parts", pa.list_(pa.binary())), ("figures", pa.list_(pa.float64()))])


def mixed(keys: np.ndarray, salt: int = 0) -> np.ndarray:
    """Well-spread 64-bit hashes of 64-bit keys."""
    x = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seat(customers: np.ndarray, pull: np.ndarray, discount: float, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish after seating its customers anew; the draws depend on the dish's key and the sweep only."""
    tables = np.minimum(customers, 1).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    c, a, key, t = customers[live].astype(np.float64), pull[live], mixed(keys[live], SEED + sweep), np.ones(len(live))
    i, step = np.ones(len(live)), 0
    while len(live):
        step += 1
        u = (mixed(key, step) >> np.uint64(11)) * 2.0**-53
        p = a / (a + i - discount * t)
        # Blocks are small enough for the binomial's first term not to vanish.
        block = np.minimum(np.maximum(1, np.minimum(i // 64, np.floor(16 / p))), c - i)
        single = block == 1
        new = ((u < p) & single).astype(np.float64)
        many = np.flatnonzero(~single)
        if len(many):
            new[many] = binomial(u[many], block[many], p[many])
        t += new
        i += block
        done = i >= c
        if done.any():
            tables[live[done]] = t[done].astype(np.int64)
            stay = ~done
            live, c, a, key, t, i = live[stay], c[stay], a[stay], key[stay], t[stay], i[stay]
    return tables


def binomial(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The binomial's quantiles."""
    odds = p / np.maximum(1 - p, 1e-12)
    term = np.exp(n * np.log1p(-np.minimum(p, 1 - 1e-12)))
    k, below = np.zeros(len(u)), term.copy()
    open_ = (u >= below) & (k < n)
    while open_.any():
        term = np.where(open_, term * (n - k) / (k + 1) * odds, term)
        k = np.where(open_, k + 1, k)
        below = np.where(open_, below + term, below)
        open_ &= (u >= below) & (k < n)
    return k


def planes(array: np.ndarray) -> bytes:
    """Numbers, compressed byte place by byte place, as most differ in few bytes."""
    size = array.itemsize
    places, own = np.empty((size, len(array)), np.uint8), array.view(np.uint8).reshape(-1, size)
    for k in range(size):
        places[k] = own[:, k]
    return len(array).to_bytes(8, "little") + ZSTD.compress(places.tobytes(), asbytes=True)


def unplanes(blob: bytes, kind: type) -> np.ndarray:
    size, n = np.dtype(kind).itemsize, int.from_bytes(blob[:8], "little")
    own, places = np.empty((n, size), np.uint8), np.frombuffer(ZSTD.decompress(blob[8:], size * n), np.uint8).reshape(size, n)
    for k in range(size):
        own[:, k] = places[k]
    return own.reshape(-1).view(kind)


def pack(array: np.ndarray) -> bytes:
    """Whole numbers from 0, in as many bytes as the largest needs."""
    kind = np.min_scalar_type(int(array.max(initial=0))).char
    return kind.encode() + planes(array.astype(kind))


def unpack(blob: bytes) -> np.ndarray:
    return unplanes(blob[1:], blob[:1].decode()).astype(np.int64)


def listed(hashes: np.ndarray) -> bytes:
    """Distinct hashes in order, as steps."""
    return planes(np.diff(hashes, prepend=np.uint64(0)))


def names(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob, np.uint64), dtype=np.uint64)


def rows_of(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table({field.name: pa.array(list(column), field.type) for field, column in zip(SCHEMA, columns, strict=True)}, SCHEMA)


def by_part(which: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(part, its rows in their order)."""
    order = np.argsort(which.astype(np.min_scalar_type(int(which.max(initial=0)))), kind="stable")  # narrow numbers are sorted by radix
    edges = np.flatnonzero(np.diff(which[order])) + 1
    return [(int(which[part[0]]), part) for part in np.split(order, edges) if len(part)]


def summed(keys: list[np.ndarray], *values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    found, at = np.unique(np.concatenate([*keys, np.empty(0, np.uint64)]), return_inverse=True)
    return (found, *[np.bincount(at, weights=np.concatenate([*v, np.empty(0)]), minlength=len(found)).astype(np.int64) for v in values])


class Split:
    """Which bucket a pair belongs to."""

    def __init__(self, buckets: int, often: dict[int, int]):
        self.buckets = buckets
        self.contexts = np.array(sorted(often), np.uint64)
        self.shares = np.array([often[k] for k in sorted(often)], np.uint64)

    def shared(self, contexts: np.ndarray) -> np.ndarray:
        if not len(self.contexts):
            return np.zeros(len(contexts), bool)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return self.contexts[at] == contexts

    def bucket(self, contexts: np.ndarray, followers: np.ndarray) -> np.ndarray:
        key = mixed(contexts)
        often = np.flatnonzero(self.shared(contexts))
        if len(often):
            share = mixed(followers[often], 2) % self.shares[np.searchsorted(self.contexts, contexts[often])]
            key[often] = mixed(key[often] + share)
        return (key % np.uint64(self.buckets)).astype(np.int64)

    def word_bucket(self, hashes: np.ndarray) -> np.ndarray:
        return self.buckets + (mixed(hashes, 1) % np.uint64(self.buckets)).astype(np.int64)


def numbered_words(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Each token's number, the tokens of each text, each closed by END, and the spelling of each number."""
    lists = [pc.ascii_split_whitespace(pc.ascii_lower(part.cast(pa.string(), safe=False))) for part in texts.chunks]  # bytes that are no UTF-8 stay
    found = pa.chunked_array([part.flatten() for part in lists], pa.string()).dictionary_encode().unify_dictionaries()
    spelled = [*(found.chunk(0).dictionary.cast(pa.binary()).to_pylist() if found.num_chunks else []), END]
    number = np.concatenate([*(part.indices.to_numpy() for part in found.chunks), np.empty(0, np.int32)]).astype(np.int64)
    word = number != (spelled.index(b"") if b"" in spelled else -1)  # white space at either end gives an empty piece
    before = np.concatenate(([0], np.cumsum(word)))
    pieces = np.concatenate([pc.list_value_length(part).to_numpy(zero_copy_only=False) for part in lists]).astype(np.int64)
    until = np.cumsum(pieces)
    sizes = before[until] - before[until - pieces] + 1
    token = np.full(sizes.sum(), len(spelled) - 1)
    inner = np.ones(len(token), bool)
    inner[np.cumsum(sizes) - 1] = False
    token[inner] = number[word]
    return token, sizes, spelled


class Tokens:
    """A chunk's tokens: the document of each, its word and its (context, word) pair among the chunk's distinct ones."""

    def __init__(self, table: pa.Table, holdout: tuple[int, int]):
        ids = table.column("doc_id").to_pylist()
        modulus, held = holdout
        self.held_out = np.array([zlib.crc32(str(i if i is not None else "").encode()) % modulus == held for i in ids], bool)
        token, self.sizes, spelled = numbered_words(table.column("data"))
        hashes = np.array([*(xxhash.xxh64_intdigest(w, SEED) for w in spelled), START], np.uint64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        context = np.empty(len(token), np.int64)
        context[1:] = token[:-1]
        context[self.starts] = len(spelled)
        # Rows may come in any order, so pairs are put in the order of their hashes, not of their first occurrence.
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs, self.pair_of = np.unique(rank[context] * len(hashes) + rank[token], return_inverse=True)
        hashes = hashes[order]
        self.context, self.word = hashes[pairs // len(hashes)], hashes[pairs % len(hashes)]
        train = np.repeat(~self.held_out, self.sizes)
        self.count = np.bincount(self.pair_of, weights=train, minlength=len(pairs)).astype(np.int64)


def coded(contexts: np.ndarray, followers: np.ndarray) -> list[bytes]:
    """Pairs, in order, as distinct hashes and numbers into them."""
    spelled, at = np.unique(np.concatenate([contexts, followers]), return_inverse=True)
    first, second = at[: len(contexts)], at[len(contexts) :]
    return [listed(spelled), pack(np.diff(first, prepend=0)), pack(second)]


def decoded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return names(parts[0]), np.cumsum(unpack(parts[1])), unpack(parts[2])


def _ask(split: Split, holdout: tuple[int, int]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        tokens = Tokens(table, holdout)
        return rows_of([(bucket, PAIRS, key[0].as_py(), [*coded(tokens.context[some], tokens.word[some]), pack(tokens.count[some])], None) for bucket, some in by_part(split.bucket(tokens.context, tokens.word))])

    return run


def _tell(split: Split, bucket: int, kind: int, hashes: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """Rows to the buckets of words, with the words' hashes and figures."""
    return [(to, kind, bucket, [listed(hashes[some]), *[pack(v[some]) for v in values]], None) for to, some in by_part(split.word_bucket(hashes))]


def _shared(split: Split, bucket: int, contexts: np.ndarray, *values: np.ndarray) -> list[tuple]:
    often = split.shared(contexts)
    return [(-1, SHARED, bucket, [listed(contexts[often]), *[pack(v[often]) for v in values]], None)] if often.any() else []


def _gather(split: Split):
    """A bucket's pairs from all chunks; the first seating, of one table a dish."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("to")[0].as_py()
        asked = [decoded(p) for p in table.column("parts").to_pylist()]
        spelled, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        code, begin = [], 0
        for own, first, second in asked:
            number = at[begin : begin + len(own)]
            begin += len(own)
            code.append(number[first] * len(spelled) + number[second])
        pairs, pair_of = np.unique(np.concatenate(code), return_inverse=True)
        count = np.bincount(pair_of, weights=np.concatenate([unpack(p[3]) for p in table.column("parts").to_pylist()]), minlength=len(pairs)).astype(np.int64)
        context, word = pairs // len(spelled), pairs % len(spelled)
        out = [(bucket, PAIRS, bucket, [listed(spelled), pack(np.diff(context, prepend=0)), pack(word), pack(count)], None)]
        begin = 0
        for chunk, own in zip(table.column("sender").to_pylist(), code, strict=True):
            out.append((bucket, CHUNK, chunk, [pack(np.diff(pair_of[begin : begin + len(own)], prepend=0))], None))
            begin += len(own)
        sums = lambda of, x: np.bincount(of, weights=x, minlength=len(spelled)).astype(np.int64)
        seen = np.unique(word)
        out += _tell(split, bucket, NAMES, spelled[seen], sums(word, count)[seen], sums(word, count == 1)[seen])
        of_context, fixed = sums(context, count), sums(context, count == 1)
        kept = np.flatnonzero(of_context)
        out += _shared(split, bucket, spelled[kept], of_context[kept], fixed[kept], sums(context, count > 1)[kept])
        again = count > 1
        c, w, n = context[again], word[again], count[again]
        out.append((bucket, SEATING, bucket, [*coded(spelled[c], spelled[w]), pack(n), pack(np.ones(len(n), np.int64)), pack(fixed[np.unique(c)])], None))
        found, tables = summed([spelled[w]], [np.ones(len(n))])
        return rows_of(out + _tell(split, bucket, TABLES, found, tables))

    return run


def _root(split: Split, sweep: int, pull: float):
    """A bucket of words: sum what the buckets of contexts told, seat the parent, answer them. Others' rows pass."""

    def run(table: pa.Table) -> pa.Table:
        to = table.column("to")[0].as_py()
        if to < split.buckets:
            return table
        rows = table.to_pylist()
        asked = [(r["sender"], names(r["parts"][0]), unpack(r["parts"][1])) for r in rows if r["kind"] == TABLES]
        if sweep:
            known = next(r["parts"] for r in rows if r["kind"] == ROOT)
            spelled, count, fixed = names(known[0]), unpack(known[1]), unpack(known[2])
        else:
            told = [r["parts"] for r in rows if r["kind"] == NAMES]
            spelled, count, fixed = summed([names(p[0]) for p in told], [unpack(p[1]) for p in told], [unpack(p[2]) for p in told])
        customers = fixed.copy()
        places = [np.searchsorted(spelled, a[1]) for a in asked]
        for at, (_, _, tables) in zip(places, asked, strict=True):
            customers[at] += tables
        tables = seat(customers, np.full(len(spelled), pull), PARENT[0], spelled, sweep) if sweep else np.minimum(customers, 1)
        figures = [float(x) for x in (count.sum(), (count > 0).sum(), customers.sum(), tables.sum())]
        out = [(to, ROOT, sweep, [listed(spelled), pack(count), pack(fixed), pack(customers), pack(tables)], figures)]
        out += [(sender, REPLY, to, [listed(a), pack(customers[at]), pack(tables[at])], None) for at, (sender, a, _) in zip(places, asked, strict=True)]
        return rows_of(out)

    return run


def _seat(split: Split, sweep: int, parent: tuple[float, float, float], shared: dict[int, int]):
    """A bucket of contexts: seat the dishes that can change, given the parent as it was told. Others' rows pass."""
    known, root_customers, root_tables = parent
    contexts = np.array(sorted(shared), np.uint64)
    sums = np.array([shared[k] for k in sorted(shared)], np.float64)

    def run(table: pa.Table) -> pa.Table:
        to = table.column("to")[0].as_py()
        if to < 0 or to >= split.buckets:
            return table
        rows = table.to_pylist()
        state = next(r["parts"] for r in rows if r["kind"] == SEATING)
        spelled, context, word = decoded(state)
        count, tables, fixed = unpack(state[3]), unpack(state[4]), unpack(state[5])
        customers, seated = np.zeros(len(spelled), np.int64), np.zeros(len(spelled), np.int64)
        for r in rows:
            if r["kind"] == REPLY:
                at = np.searchsorted(spelled, names(r["parts"][0]))
                customers[at], seated[at] = unpack(r["parts"][1]), unpack(r["parts"][2])
        own = np.unique(context)
        totals = np.bincount(context, weights=tables, minlength=len(spelled))
        totals[own] += fixed
        often = own[split.shared(spelled[own])]
        totals[often] = sums[np.searchsorted(contexts, spelled[often])]
        others = np.maximum(customers[word] - tables, 0)
        share = np.minimum(seated[word], others)
        base = (np.maximum(others - PARENT[0] * share, 0) + (PARENT[1] + PARENT[0] * root_tables) / (known + 1)) / (PARENT[1] + root_customers)
        new = seat(count, (CONTEXT[1] + CONTEXT[0] * totals[context]) * base, CONTEXT[0], mixed(spelled[context], 3) ^ spelled[word], sweep)
        out = [(to, SEATING, sweep, [*state[:4], pack(new), state[5]], None)]
        # Of a split context only these tables are told: its dishes with one customer keep theirs.
        out += _shared(split, to, spelled[own], np.bincount(context, weights=new, minlength=len(spelled)).astype(np.int64)[own])
        found, told = summed([spelled[word]], [new])
        return rows_of(out + _tell(split, to, TABLES, found, told))

    return run


def _base(table: pa.Table) -> pa.Table:
    """A bucket of words answers with the words' counts, and the parent's customers and tables of them in each sample."""
    rows = table.to_pylist()
    to = rows[0]["to"]
    samples = sorted((r for r in rows if r["kind"] == ROOT), key=lambda r: r["sender"])
    spelled, count = names(samples[0]["parts"][0]), unpack(samples[0]["parts"][1])
    figures = [unpack(part) for r in samples for part in r["parts"][3:]]
    out = []
    for r in rows:
        if r["kind"] == NAMES:
            at = np.searchsorted(spelled, names(r["parts"][0]))
            out.append((r["sender"], REPLY, to, [r["parts"][0], pack(count[at]), *[pack(x[at]) for x in figures]], None))
    return rows_of(out)


def _answer(split: Split, shared: dict[int, tuple[int, dict[int, int]]], roots: dict[int, list[float]]):
    """A bucket of contexts answers each chunk with log10 probabilities of its pairs and counts of their words."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = rows[0]["to"]
        pairs = next(r["parts"] for r in rows if r["kind"] == PAIRS)
        spelled, context, word = decoded(pairs)
        count = unpack(pairs[3])
        replies = [r["parts"] for r in rows if r["kind"] == REPLY]
        word_count = np.zeros(len(spelled), np.int64)
        base = np.zeros((SAMPLES, len(spelled)))
        for parts in replies:
            at = np.searchsorted(spelled, names(parts[0]))
            word_count[at] = unpack(parts[1])
            for k in range(SAMPLES):
                _, known, root_customers, root_tables = roots[BURN_IN + 1 + k]
                guests, seated = unpack(parts[2 + 2 * k]), unpack(parts[3 + 2 * k])
                base[k, at] = (guests - PARENT[0] * seated + (PARENT[1] + PARENT[0] * root_tables) / (known + 1)) / (PARENT[1] + root_customers)
        customers = np.bincount(context, weights=count, minlength=len(spelled))
        own = np.unique(context)
        often = own[split.shared(spelled[own])]
        for at in often:
            customers[at] = shared.get(int(spelled[at]), (0, {}))[0]
        again = np.flatnonzero(count > 1)
        mass = np.zeros(len(count))
        for k, seating in enumerate(sorted((r for r in rows if r["kind"] == SEATING), key=lambda r: r["sender"])):
            tables = np.minimum(count, 1)
            tables[again] = unpack(seating["parts"][4])
            totals = np.bincount(context, weights=tables, minlength=len(spelled))
            for at in often:
                totals[at] = shared.get(int(spelled[at]), (0, {}))[1].get(seating["sender"], 0)
            mass += count - CONTEXT[0] * tables + (CONTEXT[1] + CONTEXT[0] * totals[context]) * base[k, word]
        log_p = np.log10(mass / SAMPLES / (CONTEXT[1] + customers[context])).astype(np.float32)
        told = word_count[word]
        out = []
        for r in rows:
            if r["kind"] == CHUNK:
                at = np.cumsum(unpack(r["parts"][0]))
                out.append((r["sender"], FOUND, bucket, [planes(log_p[at]), pack(told[at])], None))
        return rows_of(out)

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(split: Split, holdout: tuple[int, int], n: float, v: float):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        tokens = Tokens(docs, holdout)
        by_bucket = dict(zip(told.column("sender").to_pylist(), told.column("parts").to_pylist(), strict=True))
        log_p, count = np.empty(len(tokens.word)), np.empty(len(tokens.word), np.int64)
        for bucket, some in by_part(split.bucket(tokens.context, tokens.word)):
            said = by_bucket[bucket]
            log_p[some], count[some] = unplanes(said[0], np.float32), unpack(said[1])
        per_pair = [log_p, np.log10((count + 1) / (n + 1 * (v + 1))), (count > 0).astype(np.int64)]
        score, base, known = [np.add.reduceat(x[tokens.pair_of], tokens.starts) for x in per_pair]
        rows = {"doc_id": docs.column("doc_id"), "held_out": tokens.held_out, "n_tokens": tokens.sizes, "n_known": known, "train_tokens": np.full(docs.num_rows, int(n)), "base_score": base, "score": score}
        return pa.table(rows, schema)

    return run


def frequent_contexts(base: DataFrame, total: int, buckets: int) -> dict[int, int]:
    """Hashes of words that make over half a bucket's tokens in a sample of the texts, and over how many buckets to split each."""
    if buckets == 1 or not total:
        return {}
    wanted = max(SAMPLE_LEAST, SAMPLE_A_BUCKET * buckets)
    steps = max(1, total // wanted)
    some = base.where(F.pmod(F.xxhash64("data", F.lit(1)), F.lit(steps)) == 0)
    counted = some.select(F.explode(F.concat(words(F.translate(F.col("data").cast("string"), _UPPER, _UPPER.lower())), F.array(F.lit("")))).alias("word"))
    counted = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(20, sizes / (2 * buckets))
    found = {r.word: max(2, math.ceil(r.n * 2 * buckets / sizes)) for r in counted.where(F.col("n") > least).collect()}  # under 2 * buckets rows
    return {(xxhash.xxh64_intdigest(w.encode(), SEED) if w else START): k for w, k in found.items()}


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", holdout: tuple[int, int] = (7, 2), chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; log10. A row per row."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("data"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    chunks, buckets = max(1, math.ceil(total / chunk_bytes)), max(1, math.ceil(total / bucket_bytes))
    split = Split(buckets, frequent_contexts(base, total, buckets))
    usual = shuffle_partitions(spark)

    def grouped(frame: DataFrame, column: str, groups: int):
        """By a column; in more partitions than usual if a task would get too many groups."""
        tasks = math.ceil(groups / GROUPS_A_TASK)
        return (frame.repartition(tasks, column) if tasks > usual else frame).groupBy(column)

    dealt = grouped(base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "data"), F.lit(chunks))), "chunk", chunks)
    scratch = Scratch(spark)
    rounds = [F.pmod("to", F.lit(min(ROUNDS, buckets))) == k for k in range(min(ROUNDS, buckets))]

    def by_rounds(store: Scratch, make) -> DataFrame:
        """One share of the buckets after the other, so that shuffle files are on disk for one share only."""
        return functools.reduce(DataFrame.unionByName, [store.write(lambda: make(share)) for share in rounds])  # noqa: B023

    requests = scratch.write(lambda: dealt.applyInArrow(_ask(split, holdout), ROWS))
    first = by_rounds(scratch, lambda share: grouped(requests.where(share), "to", buckets).applyInArrow(_gather(split), ROWS))
    delete_folder(spark, f"{scratch.folder}/1")
    small, moving = F.col("kind").isin(SEATING, NAMES, TABLES), F.col("kind").isin(SEATING, TABLES, ROOT, REPLY)

    def figures(frame: DataFrame) -> list[float]:
        row = frame.where(F.col("kind") == ROOT).agg(*[F.sum(F.col("figures")[k]).alias(f"x{k}") for k in range(4)]).first()
        return [float(x or 0) for x in row]

    def of_shared(frame: DataFrame) -> dict[int, list[int]]:
        """Sums over the parts of split contexts, of which there are under 2 * buckets."""
        found: dict[int, list[int]] = {}
        for row in frame.where(F.col("kind") == SHARED).select("parts").collect():
            for key, *values in zip(names(row.parts[0]).tolist(), *[unpack(p).tolist() for p in row.parts[1:]], strict=True):
                found[key] = [a + b for a, b in zip(found.get(key, [0] * len(values)), values, strict=True)]
        return found

    state = scratch.write(lambda: grouped(first.where(small), "to", 2 * buckets).applyInArrow(_root(split, 0, 0.0), ROWS))
    roots, opened = {0: figures(state)}, of_shared(first)
    split_customers = {k: v[0] for k, v in opened.items()}
    split_tables = {0: {k: v[1] + v[2] for k, v in opened.items()}}
    kept = []
    for sweep in range(1, BURN_IN + SAMPLES + 1):
        _, known, customers, tables = roots[sweep - 1]
        pull = (PARENT[1] + PARENT[0] * tables) / (known + 1)
        seated = _seat(split, sweep, (known, customers, tables), split_tables[sweep - 1])
        before = state
        state = scratch.write(lambda: grouped(grouped(before.where(moving), "to", 2 * buckets).applyInArrow(seated, ROWS), "to", 2 * buckets).applyInArrow(_root(split, sweep, pull), ROWS))  # noqa: B023
        roots[sweep] = figures(state)
        changed = of_shared(state)
        split_tables[sweep] = {k: v[1] + changed.get(k, [0])[0] for k, v in opened.items()}
        if sweep > BURN_IN:
            kept.append(state)
        if sweep <= BURN_IN + 1:
            delete_folder(spark, f"{scratch.folder}/{scratch.count - 1}")
    samples = kept[0]
    for more in kept[1:]:
        samples = samples.unionByName(more)
    asked = first.where(F.col("kind") == NAMES).unionByName(samples.where(F.col("kind") == ROOT))
    replies = scratch.write(lambda: grouped(asked, "to", buckets).applyInArrow(_base, ROWS))
    shared = {k: (c, {s: split_tables[s][k] for s in range(BURN_IN + 1, BURN_IN + SAMPLES + 1)}) for k, c in split_customers.items()}
    waiting = first.where(F.col("kind").isin(PAIRS, CHUNK)).unionByName(samples.where(F.col("kind") == SEATING)).unionByName(replies)
    answers = by_rounds(Scratch(spark), lambda share: grouped(waiting.where(share), "to", buckets).applyInArrow(_answer(split, shared, roots), ROWS))
    scratch.clear()
    return dealt.cogroup(grouped(answers, "to", chunks)).applyInArrow(_score(split, holdout, *roots[0][:2]), SCORED)


def perplexity(scored: DataFrame, by: str = "held_out") -> DataFrame:
    """Perplexity per token of the model and of the base, by a column of score_texts()."""
    return scored.groupBy(by).agg(
        F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"), F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity")
    )
