"""URL filters: rules on hosts and paths, and wildcard rules, matched at once by one bit-parallel automaton.

Method: every rule becomes a glob over the canonical URL `.host/path?query` (A-Z of the host lower-cased, scheme and
fragment left out, a dot put before the host). A rule on a host and a path is `*.host/path*`, whose first star stays
inside the host; a wildcard rule has `*` for any run and `?` for any one byte, and stands for the whole canonical URL.
The places of all globs are packed into 64-bit words: bit i of D says that the first i places of its glob have been
read. A step of all URLs at once is D' = ((D << 1) & B[c]) | (D & L[c]), where B has the places that byte c may fill
and L the places that lie in a star which c may lengthen; shifted bits are carried from word to word.

A URL gets the rule on host and path with the longest text (the first of the list among equal ones) and its action;
without one, the wildcard rule with the longest text; without one, `default`.

Defined cases: a null URL, or one without `://`, has an empty host and path and no rule; it gets `default`. Long URLs
are read whole (a step for each byte). Repeated rows are judged each; an empty table gives an empty table; input
columns that bear a result's name are replaced. Rules are few and fixed, so only they go to the tasks; URLs are
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from freshet.llm.common import ascii_lower, packed, unpacked
from freshet.llm.spans import text_bytes

RESULTS = ("host", "path", "rule", "glob", "verdict")


@dataclass(frozen=True)
class HostRule:
    """Fits the host, all its subdomains, and paths that begin with `path`."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class GlobRule:
    """`*` is any run of bytes, `?` is any one byte; stands for the whole canonical URL."""

    action: str
    glob: str

    @property
    def text(self) -> str:
        return self.glob


#: The method's own rules: pages that hold no text of their own.
GLOBS = (
    GlobRule("block", "*/login*"),
    GlobRule("block", "*/cart/*"),
    GlobRule("block", "*/wp-admin/*"),
    GlobRule("block", "*.exe"),
    GlobRule("block", "*.zip"),
    GlobRule("block", "*?sessionid=*"),
)


def canonical(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query with its question mark) of a URL; empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    piece = lambda i: F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)((?:\?[^#]*)?)", i)
    return ascii_lower(piece(1)), piece(2), piece(3)


class Automaton:
    """All rules as one multiword Shift-And machine."""

    def __init__(self, rules: Sequence[HostRule | GlobRule]):
        every, none, in_host = np.ones(256, bool), np.zeros(256, bool), np.ones(256, bool)
        in_host[[ord("/"), ord("?")]] = False
        places: list[tuple[np.ndarray, np.ndarray]] = []  # bytes that may fill a place, bytes that may lengthen it
        starts, early, late = [], [], []
        self.ends: list[int] = []  # the place where each rule is complete
        for rule in rules:
            starts.append(len(places))
            if isinstance(rule, HostRule):
                places.append((none, in_host))
                places += [(self._only(b), none) for b in f".{rule.host}{rule.path}".encode()]
            else:
                places.append((none, none))
                for token in rule.glob:
                    if token == "*":
                        places[-1] = (places[-1][0], every)
                    elif token == "?":
                        places.append((every, none))
                    else:
                        places += [(self._only(b), none) for b in token.encode()]
            self.ends.append(len(places) - 1)
            (early if isinstance(rule, HostRule) else late).append(len(places) - 1)
        self.width = max(1, -(-len(places) // 64))
        self.fill = np.zeros((256, self.width), np.uint64)
        self.loop = np.zeros((256, self.width), np.uint64)
        for i, (fills, lengthens) in enumerate(places):
            bit = np.uint64(1) << np.uint64(i % 64)
            self.fill[fills, i // 64] |= bit
            self.loop[lengthens, i // 64] |= bit
        self.initial, self.early, self.late = (self._mask(x) for x in (starts, early, late))

    @staticmethod
    def _only(byte: int) -> np.ndarray:
        row = np.zeros(256, bool)
        row[byte] = True
        return row

    def _mask(self, bits: Sequence[int]) -> np.ndarray:
        out = np.zeros(self.width, np.uint64)
        for i in bits:
            out[i // 64] |= np.uint64(1) << np.uint64(i % 64)
        return out

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(URLs, rules): which rules each URL data[offset:next offset] fits."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")  # the URLs that go on are always the first ones
        begins, ends = offsets[:-1][order], -lengths[order]
        state = np.tile(self.initial, (len(order), 1))
        done = state & self.early
        for step in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(ends, -step, "left"))
            now = state[:live]
            byte = data[begins[:live] + step]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.fill[byte]) | (now & self.loop[byte])
            done[:live] |= state[:live] & self.early
        done |= state & self.late
        out = np.zeros((len(order), len(self.ends)), bool)
        for i, end in enumerate(self.ends):
            out[order, i] = (done[:, end // 64] >> np.uint64(end % 64)) & np.uint64(1) != 0
        return out


def filter_urls(pages: DataFrame, rules: Sequence[HostRule], globs: Sequence[GlobRule] = GLOBS, url: str = "url",
                default: str = "allow") -> DataFrame:
    """The input's columns with host, path, rule (the host rule that decides), glob (the wildcard rule that would
    decide without one) and verdict."""
    rules, globs = list(rules), list(globs)
    # Longest text first; argmax then gives the first that fits.
    ranks = [sorted(range(len(some)), key=lambda i: -len(some[i].text)) for some in (rules, globs)]

    def judged(subjects: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = Automaton([*rules, *globs])
        for part in subjects:
            fits = machine.run(*text_bytes(part))
            fits[np.asarray(part.is_null())] = False
            best = []
            for some, rank, base in zip((rules, globs), ranks, (0, len(rules))):
                ordered = fits[:, [base + i for i in rank]]
                first = ordered.argmax(1) if rank else np.zeros(len(part), int)
                best.append([some[rank[i]] if hit else None for i, hit in zip(first, ordered.any(1))])
            verdict = [(r or g).action if r or g else default for r, g in zip(*best)]
            texts = [pa.array([x.text if x else None for x in column], pa.string()) for column in best]
            yield pa.StructArray.from_arrays([*texts, pa.array(verdict, pa.string())], names=list(RESULTS[2:]))

    judge = F.arrow_udf(judged, T.StructType([T.StructField(n, T.StringType()) for n in RESULTS[2:]]))
    whole = pages[f"`{url}`"].cast("string")
    host, path, query = canonical(whole)
    subject = F.when(F.instr(whole, "://") > 0, F.concat(F.lit("."), host, path, query))
    seen = pages.select(packed(pages), host.alias("host"), path.alias("path"), judge(subject).alias("judged"))
    return seen.select(*unpacked(pages.columns, replaced=set(RESULTS)), "host", "path", "judged.*")
