"""Packing documents into sequences of a fixed number of tokens.

Method: pieces are dealt at random into groups of about `group` pieces. In a group they are placed best-fit, longest
first; then a local search works on the underfull bins, emptiest first: it moves a piece, exchanges one piece for one,
or two for one, with a bin that is at least as full, whenever that raises the sum of squared fills, so
that the emptiest bins run empty. Bins that stay underfull are dealt again into fewer groups, round by round, until
one group holds them all or a round no longer helps. No step sees more than a group.

Token ids come from a public tokenizer's file; text is always ordinary text, also where it spells a special token.
Ids are computed with the tiktoken form of the vocabulary, which gives the same ids as its `tokenizers` form in a
sixth of the time (tests compare the two).

Defined cases: null text is empty text (its only token is the end mark); documents longer than a sequence are cut, the
first piece being the short one; repeated and null ids are separate documents; long runs of white space are encoded on
their own; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from freshet.llm.common import pick, stored

CAPACITY = 2048
#: Pieces of a group, and the fill from which a bin counts as full.
GROUP, FULL = 4096, 0.998
#: Tries of the local search for each open piece of a group.
TRIES = 2
#: The number of a piece in the stored table.
ROW = "_piece_row"
#: Unicode white space, as the vocabulary's pattern sees it; runs of so many characters are encoded on their own,
#: because the pattern goes back over a run step by step.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 4096
RUNS = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def encoding(path: str):
    """The byte-level vocabulary of a ranks file; no special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(coder, text: str) -> np.ndarray:
    """The ids of a text, without special tokens.

    The pattern always begins a token where white space begins, and makes one token of a run of white space but for
    its last character if other text follows; so a long run is cut out there and encoded as the one token it is.
    """
    parts, at = [], 0
    for run in RUNS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > at:
            parts.append(coder.encode_to_numpy(text[at:run.start()], disallowed_special=()))
        parts.append(np.array(coder._encode_single_piece(text[run.start():end].encode()), np.uint32))
        at = end
    if at < len(text) or not parts:
        parts.append(coder.encode_to_numpy(text[at:], disallowed_special=()))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 ranks: str | None = None, end: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, if asked for, ids) of every document's pieces."""
    path = ranks or ranks_path()
    plain = pick(docs, doc_id=doc_id, text=text)
    fields = [plain.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path)
        for part in parts:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, value in enumerate(part.column(1).to_pylist()):
                own = np.append(token_ids(coder, value or ""), end).astype("<u4")
                first = len(own) % capacity or capacity
                for k, at in enumerate([0, *range(first, len(own), capacity)]):
                    cut = own[at:first if k == 0 else at + capacity]
                    doc.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut.tobytes()))
                    if with_ids:
                        ids.append(cut.astype(np.int32))
            columns = [part.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return plain.mapInArrow(batches, T.StructType(fields))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece numbers: each piece, longest first, goes to the fullest bin that can take it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g is set if a bin with gap g is there
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = gaps >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        by_gap[gap - size].append(b)
        gaps |= 1 << (gap - size)
    return bins


def cheapest(size: np.ndarray, room: np.ndarray, capacity: int) -> np.ndarray:
    """For every total, the piece of least size that makes room for so much when it goes; -1 if none does."""
    order = np.lexsort((size, -np.minimum(room, capacity)))
    ordered = np.minimum(room, capacity)[order]
    best = np.minimum.accumulate(size[order] * len(size) + np.arange(len(size))) % max(len(size), 1)
    last = np.searchsorted(-ordered, -np.arange(capacity + 1), "right") - 1
    return np.where(last >= 0, order[best[np.maximum(last, 0)]] if len(size) else -1, -1)


def exchange(own: np.ndarray, others: np.ndarray, size: np.ndarray, room: np.ndarray, capacity: int):
    """The exchange of one or two own pieces for one other piece that moves most tokens; None if none moves any."""
    if not len(others):
        return None
    taken = cheapest(size[others], room, capacity)
    lengths, first = np.unique(size[own], return_index=True)
    twice = np.array([np.flatnonzero(size[own] == x)[1] if (size[own] == x).sum() > 1 else -1 for x in lengths])
    i, j = np.triu_indices(len(lengths))
    able = (i != j) | (twice[i] >= 0)
    given = [*((p, -1) for p in first), *zip(first[i[able]], np.where(i == j, twice[i], first[j])[able])]
    totals = np.array([*lengths, *(lengths[i] + lengths[j])[able]])
    fits = np.flatnonzero(totals <= capacity)
    fits = fits[taken[totals[fits]] >= 0]
    gain = totals[fits] - size[others[taken[totals[fits]]]]
    if not len(fits) or gain.max() <= 0:
        return None
    k = fits[int(gain.argmax())]
    return [int(own[p]) for p in given[k] if p >= 0], int(others[taken[totals[k]]])


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Raise the sum of squared fills of the underfull bins by moves and exchanges until no bin has one that does;
    empty bins are left out.

    Every step gives tokens to a bin that is at least as full. A bin that found no step is tried again only after a
    bin that it could give to has changed. The search ends early after `TRIES` tries for each open piece: where nearly
    all bins are open, more would take minutes for a group.
    """
    fill = np.array([int(lengths[b].sum()) for b in bins])
    open_bins = np.flatnonzero(fill < capacity)
    if len(open_bins) < 2:
        return bins
    item = np.array([i for b in open_bins for i in bins[b]])
    home = np.repeat(np.arange(len(open_bins)), [len(bins[b]) for b in open_bins])
    size, full = lengths[item].astype(np.int64), fill[open_bins].astype(np.int64)
    stuck = np.zeros(len(full), bool)
    for _ in range(TRIES * len(item)):
        waiting = np.flatnonzero((full > 0) & (full < capacity) & ~stuck)
        if not len(waiting):
            break
        target = int(waiting[full[waiting].argmin()])
        own = np.flatnonzero(home == target)
        gap = capacity - full
        fuller = full >= full[target]
        fuller[target] = False
        # Move the longest piece that fits anywhere to the fullest place for it.
        most = gap[fuller].max(initial=0)
        small = own[size[own] <= most]
        if len(small):
            piece = int(small[size[small].argmax()])
            fits = np.flatnonzero(fuller & (gap >= size[piece]))
            given, taken, to = [piece], [], int(fits[gap[fits].argmin()])
        else:
            others = np.flatnonzero(fuller[home])
            found = exchange(own, others, size, size[others] + gap[home[others]], capacity)
            if found is None:
                stuck[target] = True
                continue
            given, taken, to = found[0], [found[1]], int(home[found[1]])
        moved = int(size[given].sum() - size[taken].sum())
        home[given], home[taken] = to, target
        full[to] += moved
        full[target] -= moved
        stuck[full <= full[to]] = False
    done = [b for k, b in enumerate(bins) if fill[k] == capacity]
    again: dict[int, list[int]] = {}
    for i, h in zip(item.tolist(), home.tolist()):
        again.setdefault(h, []).append(i)
    return done + list(again.values())


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and the bin's fill for every piece."""
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    where, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
    for k, b in enumerate(bins):
        sizes = lengths[b]
        where[b], offset[b], fill[b] = k, np.cumsum(sizes) - sizes, sizes.sum()
    return where, offset, fill


def packed_group(capacity: int, mark: int):
    def pack(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy().astype(np.int64)
        where, offset, fill = pack_lengths(lengths, capacity)
        group = table["group"].to_numpy()
        made = [pa.array((np.int64(mark) << 56) + (group << 24) + where), pa.array(offset), pa.array(fill)]
        kept = table.drop_columns(["group"])
        return pa.Table.from_arrays([*kept.columns, *made], names=[*kept.column_names, "sequence_id", "offset", "fill"])

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, full: float = FULL) -> DataFrame:
    """The pieces (with a column length of 1 to capacity) with sequence_id and offset.

    Pieces are dealt by their number in the stored table, so equal rows come into different groups.
    """
    rest, done, mark = stored(pieces.withColumn(ROW, F.monotonically_increasing_id()), "pieces"), [], 0
    n = rest.count()
    while True:
        groups = max(1, -(-n // group))
        dealt = rest.withColumn("group", F.pmod(F.xxhash64(ROW, F.lit(mark)), F.lit(groups)))
        schema = T.StructType([*rest.schema.fields, *[T.StructField(c, T.LongType())
                                                        for c in ("sequence_id", "offset", "fill")]])
        placed = stored(dealt.groupBy("group").applyInArrow(packed_group(capacity, mark), schema), "packed")
        under = placed.where(F.col("fill") < capacity * full)
        left = under.count() if groups > 1 else 0
        # Go on while the open pieces become fewer; else this round's bins stay as they are.
        if groups == 1 or left == 0 or left > 0.7 * n:
            done.append(placed)
            break
        done.append(placed.where(F.col("fill") >= capacity * full))
        rest, n, mark = under.select(*pieces.columns, ROW), left, mark + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("fill", ROW)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, from packed pieces with ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
