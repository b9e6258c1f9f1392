"""Sentence alignment of bilingual documents by entropic optimal transport.

The sentences of both sides have masses by their length; each side also has a null sentence that takes what has no
counterpart, at a fixed cost. Sinkhorn scaling gives the transport plan of the costs 1 - similarity. Cells of the plan
that carry a fair part of a sentence become links, and the linked groups are one to one, merges, splits or both.
Order plays no part but for near ties, so sentences and paragraphs may move.

Null and empty texts, and texts without a counterpart, give no links. Repeated rows give repeated links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import lexicon
from foliospark.session import spread, stage, table

#: Cost of leaving mass to the null sentence, sharpness of the plan, scaling rounds.
NULL_COST, EPSILON, ROUNDS = 0.66, 0.035, 200
#: Part of the smaller sentence that a link carries, and least similarity of a link.
CARRIED, LEAST = 0.25, 0.34
#: Least similarity of the second half of a merge or split, and what it must add to that of the first.
LEAST_HALF, GAIN = 0.2, 0.06
#: Sentences of either side that are compared at once: every block of the one side with every block of the other.
BLOCK = 1000
#: Least similarity of two sentences between which mass may move: less has under a fiftieth of the null's weight.
KEPT = 0.2
#: Least similarity of a link of a single word, which is its sentence's best on both sides.
LEAST_WORD = 0.6


def plan(rows: np.ndarray, cols: np.ndarray, cost: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What the entropic transport plan with null masses moves in each of the given cells; elsewhere only the null
    sentences take and give, at NULL_COST."""
    n, m = len(a), len(b)
    p, q = np.append(a, b.sum()), np.append(b, a.sum())
    kernel, null = np.exp(-cost / EPSILON), np.exp(-NULL_COST / EPSILON)
    u, v, to_u, to_v = np.ones(n + 1), np.ones(m + 1), np.empty(n + 1), np.empty(m + 1)
    for k in range(ROUNDS):
        to_u[:n] = np.bincount(rows, kernel * v[cols], n)
        to_u[:n] += null * v[m]
        to_u[n] = null * v[:m].sum() + v[m]
        u_next = p / np.maximum(to_u, 1e-300)
        to_v[:m] = np.bincount(cols, kernel * u_next[rows], m)
        to_v[:m] += null * u_next[n]
        to_v[m] = null * u_next[:n].sum() + u_next[n]
        v = q / np.maximum(to_v, 1e-300)
        if k % 10 == 9 and np.abs(u_next - u).max() <= 1e-6 * np.abs(u_next).max():
            u = u_next
            break
        u = u_next
    return u[rows] * kernel * v[cols]


def candidates(en: list[str], ja: list[str], words: lexicon.Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, target, similarity) of all pairs of sentences that are similar enough, in order; block by block, so that
    memory grows with what is similar, not with the product of the lengths."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    sides = lexicon.Side(words, en, False), lexicon.Side(words, ja, True)
    shared = sides[0].keys_met() & sides[1].keys_met()
    sides[0].count(shared), sides[1].count(shared)
    for i in range(0, len(en), BLOCK):
        own = sides[0].block(i, i + BLOCK)
        for j in range(0, len(ja), BLOCK):
            sim = lexicon.block_similarity(own, sides[1].block(j, j + BLOCK))
            x, y = np.nonzero(sim >= KEPT)
            found.append((x + i, y + j, sim[x, y].astype(np.float64)))
    rows, cols, sim = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((cols, rows))
    return rows[order], cols[order], sim[order]


def links(en: list[str], ja: list[str], words: lexicon.Lexicon) -> list[tuple[int, int, str]]:
    """(source, target, kind of group) of each linked pair of sentences."""
    n, m = len(en), len(ja)
    if not n or not m:
        return []
    rows, cols, sim = candidates(en, ja, words)
    a, b = np.array([len(s) for s in en], float), np.array([len(s) for s in ja], float)
    a, b = a / a.mean(), b / b.mean()
    drift = np.abs(rows / max(1, n - 1) - cols / max(1, m - 1))
    share = plan(rows, cols, 1.0 - sim + 0.05 * drift, a, b) / np.minimum(a[rows], b[cols])
    top_row, top_col = np.zeros(n), np.zeros(m)
    np.maximum.at(top_row, rows, sim)
    np.maximum.at(top_col, cols, sim)
    of_row, of_col = sim >= top_row[rows] - 1e-6, sim >= top_col[cols] - 1e-6
    ok = ((share >= CARRIED) | (share >= CARRIED / 2) & (of_row | of_col)) & (sim >= LEAST)
    said = np.array([len(lexicon.words_en(s)) for s in en])[rows]  # a lone number or word says little
    ok &= (said > 1) | ((said == 1) & of_row & of_col & (sim >= LEAST_WORD))
    pairs = list(zip(rows[ok].tolist(), cols[ok].tolist()))
    return groups(sorted(widened(pairs, en, ja, rows, cols, sim, words)))


def widened(pairs: list[tuple[int, int]], en: list[str], ja: list[str], rows: np.ndarray, cols: np.ndarray, sim: np.ndarray, words: lexicon.Lexicon) -> set[tuple[int, int]]:
    """The links, and those of sentences without one that make a linked sentence's counterpart more alike when put beside
    its partner: the second half of a merge or split, whose own similarity to the whole is small."""
    out, source, target = set(pairs), {}, {}
    for i, j in pairs:
        source.setdefault(i, []).append(j)
        target.setdefault(j, []).append(i)
    of = {(i, j): x for i, j, x in zip(rows.tolist(), cols.tolist(), sim.tolist())}
    near_i: dict[int, list[tuple[float, int]]] = {}
    near_j: dict[int, list[tuple[float, int]]] = {}
    for (i, j), x in of.items():
        if x >= LEAST_HALF:
            if i not in source:
                near_i.setdefault(i, []).append((-x, j))
            if j not in target:
                near_j.setdefault(j, []).append((-x, i))
    tries: list[tuple[int, int, str, str, float]] = []
    for i, best in near_i.items():
        for _, j in sorted(best)[:3]:
            if len(target.get(j, ())) == 1:
                tries.append((i, j, f"{en[target[j][0]]} {en[i]}", ja[j], of[target[j][0], j]))
    for j, best in near_j.items():
        for _, i in sorted(best)[:3]:
            if len(source.get(i, ())) == 1:
                tries.append((i, j, en[i], ja[source[i][0]] + ja[j], of[i, source[i][0]]))
    for start in range(0, len(tries), BLOCK):
        some = tries[start : start + BLOCK]
        a, b = words.vectors([t[2] for t in some], [t[3] for t in some])
        gain = (a * b).sum(axis=1) - np.array([t[4] for t in some])
        out |= {(i, j) for (i, j, *_), g in zip(some, gain) if g >= GAIN}
    return out


def groups(pairs: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Names the group of each link by the number of its sentences on either side."""
    left: dict[int, list[int]] = {}
    right: dict[int, list[int]] = {}
    for i, j in pairs:
        left.setdefault(i, []).append(j)
        right.setdefault(j, []).append(i)
    out = []
    for i, j in pairs:
        one, other = len(left[i]), len(right[j])
        out.append((i, j, "one" if one == other == 1 else "split" if other == 1 else "merge" if one == 1 else "many"))
    return out


def align(df: DataFrame, key: str, source: str, target: str, words: lexicon.Lexicon | None = None) -> DataFrame:
    """(key, src_no, tgt_no, kind) of each link. Narrow: both texts of a document are in one row. The lexicon, unless given,
    is fitted on all pairs, which are written once as they are read several times."""
    both = df.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(key), F.col(source), F.col(target))
    if words is None:
        both = stage(both, "texts")
        words = lexicon.fit_all(both, source, target)
    shared = df.sparkSession.sparkContext.broadcast(words)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = []
                for n, (a, b) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    if a and b:
                        found += [(n, *x) for x in links(lexicon.sentences_en(a), lexicon.sentences_ja(b), shared.value)]
                at, src, tgt, kinds = zip(*found) if found else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int64())), pa.array(src, pa.int32()), pa.array(tgt, pa.int32()), pa.array(kinds, pa.string())], names=[key, "src_no", "tgt_no", "kind"]
                )

    return both.mapInArrow(run, f"`{key}` {kind}, src_no int, tgt_no int, kind string")


def done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "paper_pipeline").where("status = 'done'").select("paper_id", "structured_md", "translated_text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_links(spark, sf_dir).drop("kind")


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(done(spark, sf_dir), "paper_id", "structured_md", "translated_text")


QUERIES = {"p1_found": p1_found, "p1_links": p1_links}
SQL: dict[str, str] = {}
