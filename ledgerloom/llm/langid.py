"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of labelled text; it recognises all substrings of that
text. A document is cut greedily into the longest phrases the automaton knows. Phrases times the logarithm of the sample's
length, over the letters of the document, estimate the cross entropy, whatever the lengths of the samples; the language
with the fewest of these normalised phrases wins.

Automata are sparse: the moves of all states lie in one array, each state's at a place of its own, so the alphabet has no
bound. Many stretches of text are parsed side by side, in all languages. A stretch's parse depends on where the phrase that
runs into it ends, so stretches are parsed again from there until nothing changes: phrases are those of the whole text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, labelled_sample, small_batches

#: Symbols that one lane parses; no result depends on it.
STRETCH = 4096


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in go[p]:
            go[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = go[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(symbol) == q:
                    go[p][symbol] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


def placed(state: np.ndarray, symbol: np.ndarray, states: int, width: int) -> tuple[np.ndarray, int]:
    """A place for every state, such that no two moves (place of the state plus symbol) share a cell, and the number of cells.

    Moves come sorted by state. States with many moves are placed first; all states of about one size try random places at
    once, and those whose cells are taken try again.
    """
    cells = 2 * len(state) + 2 * width + 64
    place, used, owner = np.zeros(states, np.int64), np.zeros(cells, bool), np.full(cells, -1, np.int64)
    degree = np.bincount(state, minlength=states)
    first = np.concatenate([[0], np.cumsum(degree)[:-1]])
    r = np.random.default_rng(7)
    for size in range(int(degree.max(initial=0)).bit_length(), 0, -1):
        waiting = np.flatnonzero((degree >= 1 << (size - 1)) & (degree < 1 << size))
        while len(waiting):
            n = degree[waiting]
            moves = np.repeat(first[waiting] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            tried = r.integers(0, cells - width, len(waiting))
            at = np.repeat(tried, n) + symbol[moves]
            who = state[moves]
            free = ~used[at]
            owner[at[free]] = who[free]
            bad = np.zeros(states, bool)
            bad[who[~free | (owner[at] != who)]] = True
            won = ~bad[waiting]
            place[waiting[won]] = tried[won]
            used[at[~bad[who]]] = True
            waiting = waiting[~won]
    return place, cells


class Parser:
    """Automata of all languages as one sparse table of moves."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        letters = sorted({c for s in samples.values() for c in s.lower() if c.isalpha()})
        # Codes of characters: 0 for what is no letter, which divides words; one for every letter of the samples; one for
        # all letters unknown to them; one that ends a text.
        self.other, self.end = len(letters) + 1, len(letters) + 2
        self.width = len(letters) + 3
        self.code = np.zeros(0x110000, np.int32)
        self.code[[i for i in range(0x110000) if chr(i).isalpha()]] = self.other
        for i, c in enumerate(letters):
            self.code[ord(c)] = i + 1
        state, symbol, to, self.roots, self.logs, base = [], [], [], [], [], 0
        for lang in self.langs:
            known = self.symbols(samples[lang])
            go = suffix_automaton(known.tolist())
            self.roots.append(base)
            self.logs.append(float(np.log2(len(known) + 2)))
            for s, moves in enumerate(go):
                for c in sorted(moves):
                    state.append(base + s)
                    symbol.append(c)
                    to.append(base + moves[c])
            base += len(go)
        moves = [np.array(x, np.int64) for x in (state, symbol, to)]
        # Every state has the cell of the symbol that ends a text for its own, so no two have the same place, and the place
        # can stand for the state. A cell holds the state it belongs to and where the move leads.
        own = np.argsort(np.concatenate([moves[0], np.arange(base)]), kind="stable")
        place, cells = placed(np.concatenate([moves[0], np.arange(base)])[own], np.concatenate([moves[1], np.full(base, self.end)])[own], base, self.width)
        self.cells = np.full(cells, -1, np.int64)
        self.cells[place[moves[0]] + moves[1]] = (place[moves[0]] << 32) | place[moves[2]]
        # A state without moves, from which every symbol begins a phrase: lanes start there, and unknown letters lead to it.
        self.none = int(np.setdiff1d(np.arange(len(place) + 1), place)[0]) if self.langs else 0
        self.begin = np.full((len(self.langs), self.width), self.none, np.int64)
        for k, root in enumerate(self.roots):
            mine = moves[0] == root
            self.begin[k, moves[1][mine]] = place[moves[2][mine]]

    def symbols(self, text: str) -> np.ndarray:
        """Codes of the lower-cased text, runs of other characters than letters as one divider."""
        codes = self.code[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = (codes != 0) | (np.concatenate([[1], codes[:-1]]) != 0)
        return codes[keep]

    def _parse(self, laid: np.ndarray, start: np.ndarray, stop: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every lane the phrases that begin at ``start`` or later and before ``stop``, and where the first after them begins."""
        count, over = np.zeros(len(start), np.int64), np.full(len(start), -1, np.int64)
        ids = np.flatnonzero(start < stop)
        over[start >= stop] = start[start >= stop]
        pos, last, row = start[ids].copy(), stop[ids], lang[ids] * self.width
        state = np.full(len(ids), self.none, np.int64)
        begin, tally, end = self.begin.ravel(), np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64)
        step = 0
        while len(ids):
            symbol = laid.take(pos)
            cell = self.cells.take(state + symbol)
            new = (cell >> 32) != state
            inside = pos < last
            tally += new & inside
            np.copyto(end, pos, where=(new > inside) & (end < 0))
            state = np.where(new, begin.take(row + symbol), cell & 0xFFFFFFFF)
            pos += 1
            step += 1
            if step % 64 == 0 or step < 8 or pos[0] >= len(laid) - 1:
                np.minimum(pos, len(laid) - 1, out=pos)
                if (end >= 0).any():
                    done, left = end >= 0, end < 0
                    count[ids[done]], over[ids[done]] = tally[done], end[done]
                    ids, state, pos, last, row, tally, end = (x[left] for x in (ids, state, pos, last, row, tally, end))
        return count, over

    def phrases(self, texts: list[np.ndarray], stretch: int = STRETCH) -> np.ndarray:
        """Phrases needed, by text and language."""
        n_langs = len(self.langs)
        out = np.zeros((len(texts), n_langs), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum() or not n_langs:
            return out
        # Every text is followed by a symbol that no automaton knows.
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        laid = np.full(begins[-1] + 128, self.end, np.int64)
        for t, b in zip(texts, begins.tolist(), strict=False):
            laid[b : b + len(t)] = t
        parts = -(-sizes // stretch)
        owner = np.repeat(np.arange(len(texts)), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        low = begins[owner] + number * stretch
        high = np.minimum(low + stretch, begins[owner] + sizes[owner])
        lanes = np.tile(np.arange(len(owner)), n_langs)
        lang = np.repeat(np.arange(n_langs), len(owner))
        count, over = self._parse(laid, low[lanes], high[lanes], lang)
        for k in range(n_langs):
            mine = slice(k * len(owner), (k + 1) * len(owner))
            single = parts[owner] == 1
            np.add.at(out[:, k], owner[single], count[mine][single])
        # Of texts in several stretches: what is known of a stretch, by where its first phrase begins.
        long = np.flatnonzero(parts > 1)
        firsts = (np.cumsum(parts) - parts)[long]
        known = {(k, b): {int(low[b]): (int(count[k * len(owner) + b]), int(over[k * len(owner) + b]))} for k in range(n_langs) for f, t in zip(firsts, long, strict=True) for b in range(f, f + parts[t])}
        guess = {kb: next(iter(v.values()))[1] for kb, v in known.items()}
        open_ = [(k, int(t), int(f)) for k in range(n_langs) for t, f in zip(long, firsts, strict=True)]
        while open_:
            asked, still = [], []
            for k, t, f in open_:
                at, total, missing = int(low[f]), 0, False
                for b in range(f, f + int(parts[t])):
                    if at >= high[b]:
                        continue  # a phrase that is longer than the stretch
                    found = known[k, b].get(at)
                    if found is None:
                        missing = True
                        asked.append((k, b, at))
                        at = guess[k, b]
                    else:
                        total, at = total + found[0], found[1]
                if missing:
                    still.append((k, t, f))
                else:
                    out[t, k] = total
            if asked:
                ks, bs, ats = (np.array(x, np.int64) for x in zip(*asked, strict=True))
                for k, b, at, c, o in zip(ks.tolist(), bs.tolist(), ats.tolist(), *(x.tolist() for x in self._parse(laid, ats, high[bs], ks)), strict=True):
                    known[k, b][at] = (c, o)
                    guess[k, b] = o
            open_ = still
        return out

    def judge(self, texts: list[str | None], letters_at_once: int = 2_000_000) -> tuple[list[str], list[float]]:
        """Language and score of every text: 1 minus the winner's normalised phrases over the second's."""
        langs, scores, held, size = [], [], [], 0

        def flush() -> None:
            nonlocal held, size
            needed = self.phrases(held)
            for t, row in zip(held, needed, strict=True):
                if not self.langs or not t.any():
                    langs.append("und")
                    scores.append(0.0)
                    continue
                best, *rest = sorted((n, lang) for n, lang in zip((row * self.logs).tolist(), self.langs, strict=True))
                langs.append(best[1])
                scores.append(1.0 - best[0] / rest[0][0] if rest else 1.0)
            held, size = [], 0

        for text in texts:
            held.append(self.symbols(text or ""))
            size += len(held[-1])
            if size >= letters_at_once:
                flush()
        flush()
        return langs, scores


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, cells: int = 128, letters: int = 30_000) -> dict[str, str]:
    """A sample of labelled text per language: at most ``cells`` documents drawn by hash, ``letters`` characters in all.

    Rows that are held out, or lack a text or a language, are not used. Each drawn text gives an equal share, from a place
    set by its hash, so one long text does not fill a sample. Of rows with one id and language one text counts, the share that is
    least, so the driver gets ``cells`` shares a language however often ids repeat. An empty table gives no language.
    """
    known = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    drawn = labelled_sample(known.select(F.col(id_col).alias("k"), F.col(lang_col).alias("lang")), "k", "lang", cells)
    if not drawn:
        return {}
    share = max(200, letters // cells)
    ids = docs.sparkSession.createDataFrame([(k,) for k in sorted({k for k, _ in drawn})], f"_k {docs.schema[id_col].dataType.simpleString()}")
    start = F.when(F.length(text_col) > share, F.pmod(F.xxhash64(text_col), F.length(text_col) - share + 1)).otherwise(0)
    cut = F.substring(F.col(text_col), start.cast("int") + 1, F.lit(share))
    rows = known.join(F.broadcast(ids), F.col(id_col) == F.col("_k")).select(F.col(id_col).alias("k"), F.col(lang_col).alias("lang"), cut.alias("t")).groupBy("k", "lang").agg(F.min("t").alias("t")).collect()
    out: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r.lang, str(r.k), r.t)):
        if len(out.get(r.lang, "")) < letters:
            out[r.lang] = (out.get(r.lang, "") + " " + r.t)[:letters]
    return out


_parsers: dict[str, Parser] = {}


def _parser(samples: str) -> Parser:
    """One parser per worker process and model."""
    if samples not in _parsers:
        _parsers.clear()
        _parsers[samples] = Parser(json.loads(samples))
    return _parsers[samples]


def identify(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``lang_pred`` and ``score`` (0 to 1).

    ``und`` and 0 for null texts and texts without a letter, and for all if no language was learned; of equal languages the
    first by name. Repeated rows are judged each by itself; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    model = json.dumps(samples, sort_keys=True)  # bounded: a sample per language
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(model)
        for part in parts:
            langs, scores = parser.judge(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def langid_digest(docs: DataFrame) -> DataFrame:
    """The query's columns, from :func:`fit` and :func:`identify`."""
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
