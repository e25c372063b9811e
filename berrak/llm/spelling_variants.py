"""Spelling variants by a trie of frequency vectors.

Words that differ by one inserted, deleted or replaced letter have almost equal counts of
letters. Letters are dealt to groups of about equal weight; a word's vector holds its counts by
group. Trie of such vectors: each level branches by the count of one group. A depth-first
search with a word's own vector may spend one surplus (a branch one higher than its own count)
and one deficit (one lower), no more; the words of the leaves that it reaches are verified letter
by letter. A pair is looked for once, from the longer word, or from either of two equally long ones.

The trie is cut below its first levels, the length and the counts of the first ``depth`` groups:
each subtree is one group of rows, words ask all subtrees that their budget admits (at most
3 + 3 d + d² of depth d), and carry on in it. ``depth`` grows until subtrees are small. A subtree
that is still large, or asked by many, is dealt into parts, and every part of its words meets every part
of its askers; parts are bounded in letters. So no key is one task, whatever the words look like.
Near words are counted per word and part before they are shuffled.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berrak.llm.tables import written

#: Fixed values of the task: what a run of letters is, and what is lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Variants:
    """Words have ``least_length`` letters and ``least_n`` occurrences at least; a form is ``ratio`` times as frequent as its variant."""

    least_length: int = 6
    least_n: int = 5
    ratio: int = 5
    slips: int = 199
    groups: int = 12
    most_depth: int = 8
    subtree_letters: int = 200_000
    asker_letters: int = 1_000_000


def word_counts(docs: DataFrame, how: Variants, doc_id: str, text: str) -> DataFrame:
    """word and n: runs of letters, with the planted slips (see ``variants``), counted over all texts."""
    lower = F.translate(F.col(f"`{text}`"), UPPER, LOWER)
    # a run that is too short is so with a letter less as well
    run = F.explode(F.regexp_extract_all(lower, F.lit(f"{RUN[:-1]}{{{how.least_length},}}"), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), run)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.pmod(F.col("h"), F.length("run").cast("long")) + 1).cast("int")
    slip = F.concat(F.substring("run", F.lit(1), at - 1), F.substring("run", at + 1, F.length("run")))
    word = F.when(F.pmod(F.col("h"), F.lit(how.slips)) == 0, slip).otherwise(F.col("run"))
    counted = runs.withColumn("h", h).select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= how.least_length) & (F.col("n") >= how.least_n))


def letter_groups(words: DataFrame, how: Variants) -> list[str]:
    """The letters of each group: each letter, most frequent first, goes to the group with the least weight."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count()
    # at most as many rows as RUN has letters
    counted = sorted(((r["count"], r["c"]) for r in letters.collect() if r["c"]), reverse=True)
    groups, weight = [""] * how.groups, [0] * how.groups
    for n, c in counted:
        k = weight.index(min(weight))
        groups[k] += c
        weight[k] += n
    return groups


def _count(letters: str) -> Column:
    """How many letters of a word are among ``letters``."""
    if not letters:
        return F.lit(0)
    return F.length("word") - F.length(F.translate(F.col("word"), letters, ""))


def budgets(depth: int) -> list[tuple[int, ...]]:
    """What may be added to (length, counts of ``depth`` groups) to get the first levels of a word that is near and not longer."""
    out = []
    for up, down in itertools.product(range(-1, depth), repeat=2):
        if up >= 0 and up == down:
            continue
        step = [0] * depth
        if up >= 0:
            step[up] += 1
        if down >= 0:
            step[down] -= 1
        # equally long: one letter replaced by one of any group; one shorter: a deficit only
        out.append((0, *step))
        if up < 0:
            out.append((-1, *step))
    return sorted(set(out))


def _asked(key: Column, depth: int) -> Column:
    return F.array(*[F.array(*[key[k] + d for k, d in enumerate(step)]) for step in budgets(depth)])


def _parts(rows: Column, letters: Column, most: int) -> Column:
    return F.ceil(rows * letters / F.lit(float(most))).cast("int")


def subtrees(words: DataFrame, groups: list[str], how: Variants) -> tuple[DataFrame, DataFrame, int]:
    """The words with the key of their subtree, all keys with the numbers of their parts, and the depth."""
    every = F.array(F.length("word"), *[_count(x) for x in groups[: how.most_depth]])
    keyed = written(words.withColumn("levels", every), "keyed")
    sizes = written(keyed.groupBy("levels").agg(F.count("*").alias("rows")), "sizes")
    letters = F.col("key")[0]
    for depth in range(min(3, how.most_depth), how.most_depth + 1):
        held = sizes.groupBy(F.slice("levels", 1, depth + 1).alias("key")).agg(F.sum("rows").alias("rows"))
        most = held.agg(F.max(F.col("rows") * letters)).first()[0] or 0
        if most <= how.subtree_letters:
            break
    asking = held.select(F.explode(_asked(F.col("key"), depth)).alias("key"), "rows").groupBy("key").agg(F.sum("rows").alias("askers"))
    keys = held.join(asking, "key").select("key", _parts(F.col("rows"), letters, how.subtree_letters).alias("parts"), _parts(F.col("askers"), letters + 1, how.asker_letters).alias("ask_parts"))
    return keyed.select("word", "n", F.slice("levels", 1, depth + 1).alias("key")), written(keys, "subtrees"), depth


def meetings(words: DataFrame, groups: list[str], how: Variants) -> DataFrame:
    """Words of subtrees (asks false) and those who ask them (true), by key and part: every part meets every part."""
    keyed, keys, depth = subtrees(words, groups, how)
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    ask_part = F.pmod(F.xxhash64("word"), F.col("ask_parts")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = keyed.join(keys, "key").select("key", part.alias("part"), each("ask_parts").alias("ask_part"), F.lit(False).alias("asks"), "word", "n")
    asks = keyed.select("word", "n", F.explode(_asked(F.col("key"), depth)).alias("key")).join(keys, "key")
    asks = asks.select("key", each("parts").alias("part"), ask_part.alias("ask_part"), F.lit(True).alias("asks"), "word", "n")
    return own.unionByName(asks)


# within one subtree


def _letters(words: list[str], length: int) -> np.ndarray:
    """Words of one length as a matrix of letters, a byte each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def _vectors(letters: np.ndarray, group_of: np.ndarray, groups: int) -> np.ndarray:
    counts = np.zeros((len(letters), groups), np.int32)
    at = group_of[letters] + groups * np.arange(len(letters))[:, None]
    counts += np.bincount(at.ravel(), minlength=len(letters) * groups).reshape(len(letters), groups).astype(np.int32)
    return counts


def search(own: np.ndarray, asking: np.ndarray, surplus: int, deficit: int, leaf: int = 24) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Depth-first search of all askers' vectors at once in the trie of ``own`` vectors.

    Gives places (of askers, of own words) whose vectors keep to the budgets. A node is a run of the sorted
    vectors, so that the trie needs no more memory than they; a node of few words is a leaf.
    """
    order = np.lexsort(own.T[::-1])
    trie = own[order]
    everyone = np.arange(len(asking))
    stack = [(0, len(trie), 0, everyone, np.full(len(asking), surplus), np.full(len(asking), deficit))]
    while stack:
        lo, hi, depth, who, up, down = stack.pop()
        if hi - lo <= leaf or depth == trie.shape[1]:
            for at in range(0, len(who), max(1, (1 << 20) // max(1, hi - lo))):
                some = slice(at, at + max(1, (1 << 20) // max(1, hi - lo)))
                more = trie[None, lo:hi, depth:] - asking[who[some], None, depth:]
                fits = (np.maximum(more, 0).sum(2) <= up[some, None]) & (np.maximum(-more, 0).sum(2) <= down[some, None])
                a, b = np.nonzero(fits)
                if len(a):
                    yield who[some][a], order[lo + b]
            continue
        level = trie[lo:hi, depth]
        edges = [lo, *(lo + 1 + np.flatnonzero(level[1:] != level[:-1])), hi]
        for a, b in itertools.pairwise(edges):
            spent = trie[a, depth] - asking[who, depth]
            ok = (spent <= up) & (-spent <= down)
            if ok.any():
                stack.append((a, b, depth + 1, who[ok], up[ok] - np.maximum(spent[ok], 0), down[ok] - np.maximum(-spent[ok], 0)))


def verified(asking: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether words (rows of letters) differ by exactly one replaced letter, or by one more in ``asking``."""
    if asking.shape[1] == own.shape[1]:
        return (asking != own).sum(1) == 1
    width = own.shape[1]
    head = np.cumprod(asking[:, :width] == own, axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
    tail = np.cumprod((asking[:, 1:] == own)[:, ::-1], axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
    return head + tail >= width


NEAR = "word string, n_near long, near string, near_n long"


def _near(rows: pd.DataFrame, groups: list[str]) -> pd.DataFrame:
    """For each word that is near another of this part: how many there are, and the best of them."""
    group_of = np.zeros(256, np.int64)
    for k, letters in enumerate(groups):
        group_of[np.frombuffer(letters.encode("latin-1"), np.uint8)] = k
    own = rows[~rows["asks"]]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    names, counts = rows["word"].to_numpy(), rows["n"].to_numpy(np.int64)
    if len(own):
        length = len(own["word"].iloc[0])
        mine = _letters(own["word"].tolist(), length)
        own_at = np.flatnonzero(~rows["asks"])
        sizes = rows["word"].str.len().to_numpy()
        for longer in (0, 1):
            at = np.flatnonzero(rows["asks"].to_numpy() & (sizes == length + longer))
            if not len(at):
                continue
            theirs = _letters(names[at].tolist(), length + longer)
            pairs = search(_vectors(mine, group_of, len(groups)), _vectors(theirs, group_of, len(groups)), 1 - longer, 1)
            for a, b in pairs:
                for k in range(0, len(a), step := max(1, (1 << 22) // length)):
                    x, y = a[k : k + step], b[k : k + step]
                    good = verified(theirs[x], mine[y])
                    x, y = at[x[good]], own_at[y[good]]
                    if not longer:
                        # two words of one length ask each other: only the later one's question counts
                        later = names[x] > names[y]
                        x, y = x[later], y[later]
                    found.append((x, y))
    if not found:
        return pd.DataFrame({"word": [], "n_near": [], "near": [], "near_n": []}).astype({"n_near": "int64", "near_n": "int64"})
    x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    pairs = pd.DataFrame({"word": names[np.concatenate([x, y])], "near": names[np.concatenate([y, x])], "near_n": counts[np.concatenate([y, x])]})
    pairs = pairs.sort_values(["word", "near_n", "near"], ascending=[True, False, True], kind="stable")
    grouped = pairs.groupby("word", sort=False)
    return grouped.first().assign(n_near=grouped.size()).reset_index()[["word", "n_near", "near", "near_n"]]


def near_words(words: DataFrame, how: Variants) -> DataFrame:
    """word, n_near, and the near word of largest n (of ties the first), of all words that have any."""
    groups = letter_groups(words, how)
    by_part = meetings(words, groups, how).groupBy("key", "part", "ask_part").applyInPandas(lambda x: _near(x, groups), NEAR)
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return by_part.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame, most: int, how: Variants) -> DataFrame:
    """word and root of every word that has a form (word, form): pointers are doubled until the longest chain is followed.

    Every step multiplies n by ``ratio`` at least, so that ``most`` bounds the chain.
    """
    steps = max(1, math.ceil(math.log(max(most, 2), how.ratio)))
    point = forms.select("word", F.col("form").alias("root"))
    for k in range(max(1, math.ceil(math.log2(steps)))):
        on = point.select(F.col("word").alias("root"), F.col("root").alias("further"))
        point = written(point.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"roots-{k}")
    return point


OUT = "word string, form string, root string, n long, n_near long, form_n long"


def variants(docs: DataFrame, how: Variants = Variants(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``OUT``, a row per word.

    Words are the runs of letters of all texts, A-Z lower-cased; where the crc32 h of ``<doc_id>:<run>``
    is a multiple of ``slips``, the letter h % length is left out. Two words are near if one inserted,
    deleted or replaced letter makes one the other. The form is the near word of largest n (of ties
    the first in code-point order), if that is ``ratio`` times the word's own at least; the root is the
    last of the chain of forms, or the word itself.

    Null and empty texts have no words; a null id counts as the empty string; repeated rows count
    each time; an empty table gives no rows. Texts and words may be of any length.
    """
    words = written(word_counts(docs, how, doc_id, text), "words")
    near = words.join(near_words(words, how), "word", "left")
    is_form = F.col("near_n") >= how.ratio * F.col("n")
    told = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "near-words")
    most = words.agg(F.max("n")).first()[0] or 0
    ends = roots(told.where("form IS NOT NULL"), most, how)
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
