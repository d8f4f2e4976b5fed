"""Tokens by a dictionary: the cheapest path through the lattice of all dictionary words and unknown runs of a text.

The dictionary is a table (``surface, cost, form, pos`` and, for compounds, ``parts_a, parts_b``), an optional second
table has costs of one part of speech behind another. Both are broadcast, as a dictionary is a thing of bounded size; its
size is checked. Sentences go through Arrow batches, and a stretch without white space is analysed once per task.
"""

from __future__ import annotations

import gc
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A dictionary may have so many bytes of surfaces.
MOST_BYTES = 256 << 20
#: Costs of an unknown run: for it, and for each of its characters.
UNKNOWN, EACH = 20_000, 500
#: Stretches that a task keeps, and sentences that it takes at a time.
MOST_KEPT, ROWS = 200_000, 10_000
#: Ends of stretches whose paths are kept: so many, of at most so many characters.
MOST_ENDS, END_LENGTH = 50_000, 24
START = ""
MODES = ("A", "B", "C")
STRETCH = re.compile(r"\S+")


def kind(c: str) -> str:
    """Class of a character; unknown runs are of one class."""
    if c.isdigit():
        return "number"
    if "぀" <= c <= "ゟ":
        return "hiragana"
    if "゠" <= c <= "ヿ":
        return "katakana"
    return "letter" if c.isalpha() else "mark"


@dataclass
class Entry:
    surface: str
    cost: int
    form: str
    pos: tuple[str, ...]
    parts: dict[str, tuple[str, ...]] = field(default_factory=dict)
    unknown: bool = False


class Lattice:
    def __init__(self, entries: list[Entry], connections: dict[tuple[str, str], int] | None = None, mode: str = "C"):
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        self.words: dict[str, list[Entry]] = {}
        for e in entries:
            self.words.setdefault(e.surface, []).append(e)
        #: Lengths of the words by their first two characters.
        lengths: dict[str, set[int]] = {}
        for surface in self.words:
            lengths.setdefault(surface[:2], set()).add(len(surface))
        self.lengths = {start: sorted(n) for start, n in lengths.items()}
        self.connections, self.mode = connections or {}, mode
        self._lefts: dict[str, dict[str, int]] = {}
        for (left, own), cost in self.connections.items():
            self._lefts.setdefault(left, {})[own] = cost
        self._known: dict[str, list[Entry]] = {}
        self._kinds: dict[str, str] = {}
        self._ends: dict[str, tuple] = {}

    @staticmethod
    def _first(e: Entry) -> str:
        return e.pos[0] if e.pos else ""

    def candidates(self, text: str, i: int) -> list[Entry]:
        """Words of the dictionary that start here, the run of one class from here on, and the character alone."""
        end = i + 1
        while end < len(text) and kind(text[end]) == kind(text[i]):
            end += 1
        return [e if e is not None else Entry(text[i : i + n], cost, text[i : i + n], pos, unknown=True) for n, cost, pos, e in self._found(text, i, end, kind(text[i]))]

    def _found(self, text: str, i: int, end: int, of: str) -> list[tuple[int, int, tuple[str, ...], Entry | None]]:
        """The candidates with the run's end known: length, cost, parts of speech, and the entry if it is a word. A run's
        text is only cut out if a path takes it."""
        out: list = [(1, e.cost, e.pos, e) for e in self.words.get(text[i], ())]
        for n in self.lengths.get(text[i : i + 2], ()):
            if n > 1 and i + n <= len(text):
                out += [(n, e.cost, e.pos, e) for e in self.words.get(text[i : i + n], ())]
        pos = ("unknown", of)
        out.append((1, UNKNOWN + EACH, pos, None))
        if end - i > 1:
            out.append((end - i, UNKNOWN + EACH * (end - i), pos, None))
        return out

    def _best(self, state: tuple, left: str) -> tuple:
        """The rank of the best way on from a place behind a part of speech, without its first token's length, and its first
        candidate."""
        ways, chosen, least = state
        got = chosen.get(left)
        if got is None:
            costs = self._lefts.get(left)
            if costs is not None:
                least = None
                for own, (r, c) in ways.items():
                    r += costs.get(own, 0) << 64
                    # equal ranks: by part of speech, as the first ones differ
                    if least is None or r < least[0] or (r == least[0] and c[2] < least[1][2]):
                        least = r, c
            got = chosen[left] = least[0] >> 32 << 32, least[1]
        return got

    def path(self, text: str) -> list[Entry]:
        """The cheapest path; of equals the one with fewer tokens, then with the longer token earlier, then by part of
        speech. Costs are a word's own and those of its part of speech behind the one before.

        The ways on from a place depend on the rest of the text alone, so those of short ends are kept for other texts. Of
        candidates with the same first part of speech one is the best whatever is before it."""
        size, kinds = len(text), self._kinds
        if len(self._ends) > MOST_ENDS:
            self._ends = {}
        if len(kinds) > MOST_ENDS:
            kinds.clear()

        def form(i: int, c: tuple) -> str:
            return c[3].form if c[3] is not None else text[i : i + c[0]]

        # a rank is one number: the costs, 32 bits for the number of tokens, 32 for the length of the first one
        one, best, ends = (2 << 32) - 1, self._best, self._ends
        states: list = [None] * size
        end, after = size, ""
        for i in range(size - 1, -1, -1):
            of = kinds.get(text[i])
            if of is None:
                of = kinds[text[i]] = kind(text[i])
            if of != after:
                end, after = i + 1, of
            short = text[i:] if size - i <= END_LENGTH else None
            state = ends.get(short) if short is not None else None
            if state is None:
                ways: dict[str, tuple] = {}
                least = None
                for c in self._found(text, i, end, of):
                    n, cost, pos, _ = c
                    own = pos[0] if pos else ""
                    r = (cost << 64) + one - n
                    if i + n < size:
                        r += (states[i + n][1].get(own) or best(states[i + n], own))[0]
                    had = ways.get(own)
                    if had is None or r < had[0] or (r == had[0] and (pos < had[1][2] or (pos == had[1][2] and form(i, c) < form(i, had[1])))):
                        ways[own] = r, c
                for way in ways.values():
                    if least is None or way[0] < least[0] or (way[0] == least[0] and way[1][2] < least[1][2]):
                        least = way
                state = ways, {}, least
                if short is not None:
                    ends[short] = state
            states[i] = state
        out, i, left = [], 0, START
        while i < size:
            n, cost, pos, e = best(states[i], left)[1]
            e = e if e is not None else Entry(text[i : i + n], cost, text[i : i + n], pos, unknown=True)
            out.append(e)
            i, left = i + n, self._first(e)
        return out

    def split(self, e: Entry) -> list[Entry]:
        """A compound in its parts, by the mode; a part that isn't in the dictionary is unknown."""
        parts = e.parts.get(self.mode)
        if not parts or "".join(parts) != e.surface:
            return [e]
        return [min(self.words[p], key=lambda x: (x.cost, x.pos, x.form)) if p in self.words else Entry(p, 0, p, ("unknown", kind(p[0])), unknown=True) for p in parts]

    def analyse(self, text: str) -> list[tuple[str, str, tuple[str, ...], bool]]:
        """(surface, form, parts of speech, unknown) of a text's tokens; white space is none and parts the text."""
        out = []
        for stretch in STRETCH.findall(text):
            if stretch not in self._known:
                if len(self._known) > MOST_KEPT:
                    self._known = {}
                self._known[stretch] = [x for e in self.path(stretch) for x in self.split(e)]
            out += [(e.surface, e.form, e.pos, e.unknown) for e in self._known[stretch]]
        return out


def load(entries: DataFrame, connections: DataFrame | None = None, mode: str = "C") -> Lattice:
    """A lattice from dictionary tables. ``pos`` and the parts are arrays; null forms are the surface, null costs 0; rows
    without a surface are left out, as are words with white space, which no stretch has."""
    rows = entries.where(F.length("surface") > 0).where(~F.col("surface").rlike(r"\s"))
    size = rows.agg(F.sum(F.octet_length("surface"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the dictionary has {size} bytes of surfaces, more than {MOST_BYTES}")
    has = set(rows.columns)

    def parts(r) -> dict:
        return {m: tuple(r[f"parts_{m.lower()}"]) for m in "AB" if f"parts_{m.lower()}" in has and r[f"parts_{m.lower()}"]}

    made = [Entry(r.surface, int(r.cost or 0), r.form if "form" in has and r.form is not None else r.surface, tuple(x or "" for x in (r.pos or [])) if "pos" in has else (), parts(r)) for r in rows.toLocalIterator()]
    costs = {(r.left or "", r.right or ""): int(r.cost or 0) for r in connections.toLocalIterator()} if connections is not None else {}
    return Lattice(made, costs, mode)


class Stretches:
    """Tokens of many texts as columns: a stretch is analysed once and stands for the numbers of its tokens from then on."""

    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.stretches: dict[str, list[int]] = {}

    def of(self, stretch: str) -> list[int]:
        found = self.stretches.get(stretch)
        if found is None:
            path = [x for e in self.lattice.path(stretch) for x in self.lattice.split(e)]
            tokens = [(x.form, x.surface, *(*x.pos[:4], "", "", "", "")[:4], int(x.unknown)) for x in path]
            found = self.stretches[stretch] = [self.numbers.setdefault(t, len(self.numbers)) for t in tokens]
        return found

    def tokens(self, texts: list[str | None]):
        """Row of each token, its number there, its texts (form, surface, parts of speech) and whether it is unknown."""
        if len(self.stretches) > MOST_KEPT:
            self.forget()
        found, per, known = [], [], self.stretches.get
        for t in texts:
            before = len(found)
            for stretch in t.split() if t else ():  # the same white space as STRETCH's
                found += known(stretch) or self.of(stretch)
            per.append(len(found) - before)
        counts = np.array(per, np.int64)
        rows = np.repeat(np.arange(len(texts)), counts)
        numbers = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        used, which = np.unique(np.array(found, np.int64), return_inverse=True)
        all_tokens = list(self.numbers)
        columns = list(zip(*(all_tokens[k] for k in used.tolist()))) or [()] * 7
        taken = [pa.array(c, pa.string()).take(pa.array(which)) for c in columns[:6]]
        return pa.array(rows), pa.array(numbers.astype(np.int64)), taken, pa.array(columns[6], pa.int64()).take(pa.array(which))


def dictionary_tokens(sentences: DataFrame, entries: DataFrame, connections: DataFrame | None = None, mode: str = "C") -> DataFrame:
    """Tokens of all sentences by a dictionary, with parts of speech and ``is_oov``; columns as of ``morphemes``."""
    shared = sentences.sparkSession.sparkContext.broadcast(load(entries, connections, mode))
    ids = ["paragraph_id", "sentence_id", "sentence_no_in_paragraph", "is_table_paragraph"]
    texts = ["normalized_form", "surface", "pos1", "pos2", "pos3", "pos4"]
    kept = sentences.select(*ids, "sentence_text")
    schema = ", ".join([*(f"{c} {t}" for c, t in kept.dtypes[:-1]), "token_no long", *(f"{c} string" for c in texts), "is_oov long"])

    def run(batches):
        known = Stretches(shared.value)
        gc.disable()  # hundreds of thousands of small tuples are kept, none in a cycle
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    rows, numbers, columns, unknown = known.tokens(part.column(len(ids)).to_pylist())
                    yield pa.RecordBatch.from_arrays([*(part.column(k).take(rows) for k in range(len(ids))), numbers, *columns, unknown], names=[*ids, "token_no", *texts, "is_oov"])
        finally:
            gc.enable()

    return kept.mapInArrow(run, schema)
