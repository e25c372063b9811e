"""What a sentence says in brackets and in quotation marks, as stretches of its tokens.

Brackets nest: a running depth, never below zero, is folded over the brackets alone, and a stretch
ends where it comes back to zero. One that nothing closes lasts to the sentence's end. Quotation marks pair in
turn. A sentence that is a quotation as a whole is no aside.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from berrak.functions.arrays import let

STRETCHES = "array<struct<first:int,last:int>>"
STATE = f"struct<depth:int,at:int,deepest:int,done:{STRETCHES}>"


def _state(depth: Column, at: Column, deepest: Column, done: Column) -> Column:
    return F.struct(depth.alias("depth"), at.alias("at"), deepest.alias("deepest"), done.alias("done")).cast(STATE)


def _stretch(first: Column, last: Column) -> Column:
    return F.array(F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))).cast(STRETCHES)


def brackets(toks: Column) -> Column:
    """deepest (the greatest depth), and done: stretches of tokens from an opening bracket to its closing one."""
    marks = F.filter(F.transform(toks, lambda x, i: F.struct(x["token"].alias("token"), i.alias("i"))), lambda x: x["token"].isin("(", ")"))

    def step(a: Column, x: Column) -> Column:
        opened = _state(a["depth"] + 1, F.when(a["depth"] == 0, x["i"]).otherwise(a["at"]), F.greatest(a["deepest"], a["depth"] + 1), a["done"])
        closed = _state(F.greatest(a["depth"] - 1, F.lit(0)), a["at"], a["deepest"], F.when(a["depth"] == 1, F.concat(a["done"], _stretch(a["at"], x["i"]))).otherwise(a["done"]))
        return F.when(x["token"] == "(", opened).otherwise(closed)

    start = _state(F.lit(0), F.lit(0), F.lit(0), F.array().cast(STRETCHES))
    end = lambda a: F.when(a["depth"] > 0, _state(a["depth"], a["at"], a["deepest"], F.concat(a["done"], _stretch(a["at"], F.size(toks))))).otherwise(a)
    return F.aggregate(marks, start, step, end)


def quotations(toks: Column) -> Column:
    """Stretches of tokens between quotation marks that hold a word, but not all words of the sentence."""
    marks = F.filter(F.transform(toks, lambda x, i: F.struct(x["token"].alias("token"), i.cast("int").alias("i"))), lambda x: x["token"] == '"')
    words = lambda of: F.size(F.filter(of, lambda x: x["kind"] == "word"))
    inside = lambda x: words(F.slice(toks, x["first"] + 1, x["last"] - x["first"] + 1))

    def paired(own: Column) -> Column:
        pairs = F.transform(own, lambda x, k: F.struct(x["i"].alias("first"), F.get(own, k + 1)["i"].alias("last")))
        pairs = F.filter(pairs, lambda x, k: (k % 2 == 0) & x["last"].isNotNull())
        return let(words(toks), lambda n: F.filter(pairs, lambda x: inside(x).between(1, n - 1)))

    return F.when(F.exists(toks, lambda x: x["token"] == '"'), let(marks, paired).cast(STRETCHES)).otherwise(F.array().cast(STRETCHES))


def within(stretches: Column, i: Column) -> Column:
    """Whether the i-th token stands inside one of the stretches."""
    return F.exists(stretches, lambda s: (i > s["first"]) & (i < s["last"]))


def outside(toks: Column) -> Column:
    """The tokens with those in asides taken for other than words, so that every token keeps its number; unchanged where there is no aside."""
    stretches = F.concat(brackets(toks)["done"], quotations(toks))
    has = F.exists(toks, lambda x: x["token"].isin("(", '"'))

    def hidden(own: Column) -> Column:
        return F.transform(toks, lambda x, i: F.when(within(own, i), x.withField("kind", F.lit("aside"))).otherwise(x))

    return F.when(has, let(stretches, hidden)).otherwise(toks)
