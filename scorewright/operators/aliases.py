"""Many names in many texts: one automaton of all names, one pass over each text."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

#: Characters of names that one automaton holds (each is a node of some 40 bytes at most); more names are dealt to several.
AUTOMATON_CHARS = 1 << 19


def _word(c: str) -> bool:
    return c == "_" or c.isalnum()


def _latin(c: str) -> bool:
    return c.isascii() and c.isalnum()


#: What may stand before and after a name (each empty at the ends of a text), given the name.
RULES: dict[str, Callable[[str, str, str], bool]] = {
    "any": lambda a, name, z: True,
    "alnum": lambda a, name, z: not (_latin(a) or _latin(z)),
    "word": lambda a, name, z: not (_word(a) or _word(z)),
    "edge": lambda a, name, z: _word(a) != _word(name[0]) and _word(z) != _word(name[-1]),
    "unit": lambda a, name, z: not (_word(a) or z.isalpha() or z == "_"),
}


def names_found(texts: DataFrame, names: DataFrame, text: Column, *, keep: list[str], group: str | None = None, most: int = AUTOMATON_CHARS) -> DataFrame:
    """A row for each text and name that stands in it: keep, name, rule, at (first place, from 0), n (occurrences that do not overlap).

    `names` has name and rule; a name counts where its rule allows what is beside it:
    `any` anything, `alnum` no English letter or digit, `word` no letter, digit or
    underscore, `edge` a word border at both ends, `unit` as `word` but for digits after it.
    Texts and names are compared in lower case; places are those of the lowered text.
    Null texts hold nothing, blank and null names are in nothing. With `group`, one of
    `keep` and a column of the names too, a text is searched for names of its own group alone.

    The names are counted first. Up to `most` characters of them make one automaton that
    is broadcast; beyond that they are dealt to several, each of which reads the texts.
    A task holds one automaton, and what it tells of a text is bounded by the names in it.
    """
    found = _scanned(texts, names, text, keep, group, most, None)
    return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found)


def names_held(texts: DataFrame, names: DataFrame, text: Column, *, keep: list[str], told: str, most: int = AUTOMATON_CHARS) -> DataFrame:
    """A row for each text that holds names: keep, held_ (`told`, a column of the names, of each row of a name that stands in it, in ascending order), times_ (n of each), total_ (n of all, names of several rows once).

    Names that are too many for one automaton give several rows for a text. The rest is as in names_found().
    """
    return reduce(DataFrame.unionByName, _scanned(texts, names, text, keep, None, most, told))


def _scanned(texts: DataFrame, names: DataFrame, text: Column, keep: list[str], group: str | None, most: int, told: str | None) -> list[DataFrame]:
    spark = texts.sparkSession
    names = names.select(F.lower("name").alias("name"), "rule", (F.col(group) if group else F.lit("")).alias("group_of_"), *[F.col(told).alias("told_") for _ in range(told is not None)]).where("name <> '' and rule is not null and group_of_ is not null").distinct()
    size = names.agg(F.sum(F.length("name"))).first()[0] or 0
    parts = math.ceil(2 * size / most) if size > most else 1
    rows = texts.select(*keep, F.lower(text).alias("text_")).where("text_ is not null")
    schema = rows.drop("text_").schema
    if told is None:
        schema = schema.add("name", "string").add("rule", "string").add("at", "long").add("n", "long")
    else:
        schema = schema.add("held_", ArrayType(names.schema["told_"].dataType)).add("times_", ArrayType(LongType())).add("total_", "long")
    out = []
    for part in range(parts):
        some = names.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part) if parts > 1 else names
        table = some.orderBy("told_" if told else "name").toArrow().combine_chunks()
        known: dict[object, dict[str, dict[str, list[int]]]] = {}
        for i, (g, name, rule) in enumerate(zip(*[table[c].to_pylist() for c in ("group_of_", "name", "rule")], strict=True)):
            known.setdefault(g, {}).setdefault(name, {}).setdefault(rule, []).append(i)
        of_rows = table.select(["told_"] if told else ["name", "rule"])
        out.append(rows.mapInArrow(_scanner(spark.sparkContext.broadcast((known, of_rows)), keep, group, told is not None), schema))
    return out


#: Rows that a task gathers before it tells them.
TOLD = 1 << 15


def _scanner(shared, keep: list[str], group: str | None, lists: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = shared.value
        columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns]
        finders: dict[object, _Finder | None] = {}

        def finder_of(key):
            if key not in finders:
                finders[key] = _Finder(known[key]) if key in known else None
            return finders[key]

        def single(batch, rows, hits):
            """A row for each hit."""
            at = pa.array([i for i, h in zip(rows, hits, strict=True) for _ in h], pa.int64())
            which = pa.array([key[0] for h in hits for key in h], pa.int64())
            places, times = ([v[j] for h in hits for v in h.values()] for j in (0, 1))
            return pa.RecordBatch.from_arrays([*[batch[c].take(at) for c in keep], *[c.take(which) for c in columns], pa.array(places, pa.int64()), pa.array(times, pa.int64())], names=[*keep, "name", "rule", "at", "n"])

        def listed(batch, rows, hits):
            """A row for each text with hits."""
            ends, which, times, totals = [0], [], [], []
            for h in hits:
                held = sorted([(i, v[1]) for key, v in h.items() for i in key])
                which += [i for i, _ in held]
                times += [n for _, n in held]
                totals.append(sum(v[1] for v in h.values()))
                ends.append(len(which))
            ends = pa.array(ends, pa.int32())
            held = [pa.ListArray.from_arrays(ends, x) for x in (columns[0].take(pa.array(which, pa.int64())), pa.array(times, pa.int64()))]
            at = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([*[batch[c].take(at) for c in keep], *held, pa.array(totals, pa.int64())], names=[*keep, "held_", "times_", "total_"])

        gathered = listed if lists else single
        for batch in batches:
            rows, hits, n = [], [], 0
            for i, text in enumerate(batch["text_"]):
                finder = finder_of(batch[group][i].as_py() if group else "")
                found = finder.found(text.as_py()) if finder else {}
                if not found:
                    continue
                rows.append(i)
                hits.append(found)
                n += sum(map(len, found)) if lists else len(found)
                if n >= TOLD:
                    yield gathered(batch, rows, hits)
                    rows, hits, n = [], [], 0
            yield gathered(batch, rows, hits)

    return scan


#: Rules by which a name of word characters alone is a whole word of a text.
WHOLE = ("word", "edge")
_WORDS = re.compile(r"\w+")


class _Finder:
    """The names of one group in texts.

    Names that only count as whole words, short ones mostly, are looked up among the words
    of a text: in an automaton they would be met, and turned down, at nearly every letter.
    `names` gives the rows of each name and rule, which stand for both.
    """

    def __init__(self, names: dict[str, dict[str, list[int]]]):
        self.whole: dict[str, list[tuple[int, ...]]] = {}
        self.machine = ahocorasick.Automaton()
        for name, rules in names.items():
            whole = [r for r in rules if r in WHOLE and _WORDS.fullmatch(name)]
            if whole:
                self.whole[name] = [tuple(rules[r]) for r in whole]
            rest = [(tuple(rows), RULES[r]) for r, rows in rules.items() if r not in whole]
            if rest:
                self.machine.add_word(name, (name, rest))
        if len(self.machine):
            self.machine.make_automaton()

    def found(self, text: str) -> dict[tuple[int, ...], list[int]]:
        """The rows of each name and rule: the first place, and how often it stands."""
        out = _occurrences(self.machine, text) if len(self.machine) else {}
        if self.whole:
            for m in _WORDS.finditer(text):
                for key in self.whole.get(m[0], ()):
                    seen = out.get(key)
                    if seen is None:
                        out[key] = [m.start(), 1]
                    else:
                        seen[1] += 1
        return out


def _occurrences(machine: ahocorasick.Automaton, text: str) -> dict[tuple[int, ...], list[int]]:
    """The rows of each name and rule: the first place, how often it stands, and where the last ends."""
    found: dict[tuple[int, ...], list[int]] = {}
    for last, (name, entries) in machine.iter(text):
        start, end = last - len(name) + 1, last + 1
        before, after = text[start - 1 : start] if start else "", text[end : end + 1]
        for key, fits in entries:
            if fits(before, name, after):
                seen = found.get(key)
                if seen is None:
                    found[key] = [start, 1, end]
                elif start >= seen[2]:
                    seen[1], seen[2] = seen[1] + 1, end
    return found


#: Names of a group that one row holds; larger groups are cut into several.
BLOCK_NAMES = 1000


def own_names_found(texts: DataFrame, names: DataFrame, text: Column, *, id_col: str, group_col: str, most: int = AUTOMATON_CHARS) -> DataFrame:
    """id, alias: the aliases of a text's own group that stand in it between borders of the English alphabet. `names` has group_, alias and name, in lower case.

    Up to `most` characters of names are found by an automaton for each group. More of
    them, in many groups, go to the texts of their group by a join, a list of at most
    BLOCK_NAMES a row, so that no text meets another group's names.
    """
    size = names.agg(F.sum(F.length("name"))).first()[0] or 0
    texts = texts.select(id_col, F.col(group_col).alias("group_"), text.alias("body_"))
    if size <= most:
        found = names_found(texts, names.select("name", "group_", F.lit("alnum").alias("rule")), F.col("body_"), keep=[id_col, "group_"], group="group_", most=most)
        return found.join(names, ["name", "group_"]).select(id_col, "alias")
    parts = names.groupBy("group_").agg(F.ceil(F.count("*") / BLOCK_NAMES).alias("parts_"))
    dealt = names.where("name <> ''").join(parts, "group_").withColumn("part_", F.pmod(F.xxhash64("name", "alias"), "parts_"))
    lists = dealt.groupBy("group_", "part_").agg(F.collect_set(F.struct("alias", "name")).alias("names_"))
    met = texts.withColumn("low_", F.lower("body_")).join(lists, "group_")

    def stands(x: Column) -> Column:
        quoted = F.concat(F.lit(r"(^|[^a-zA-Z0-9])\Q"), F.replace(x["name"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E([^a-zA-Z0-9]|$)"))
        return F.when(F.contains(F.col("low_"), x["name"]), F.rlike(F.col("low_"), quoted)).otherwise(False)

    return met.select(id_col, F.explode(F.filter("names_", stands)).alias("x_")).select(id_col, "x_.alias")


def keyword_rule(keyword: str) -> str:
    """How a keyword counts: as a word if it is one, `rm` also before digits, else wherever it stands."""
    key = keyword.lower()
    return "unit" if key == "rm" else "word" if key.isascii() and key.isalnum() else "any"


def category_counts(texts: DataFrame, categories: dict[str, list[str]], text: Column, *, groups: list[str]) -> DataFrame:
    """groups, and for each category has_<name> (whether any text holds a keyword of it) and n_<name> (keywords found, once a text)."""
    spark = texts.sparkSession
    rows = [(c, k.lower(), keyword_rule(k)) for c, keys in categories.items() for k in dict.fromkeys(keys)]
    table = spark.createDataFrame(rows, "category string, name string, rule string")
    found = names_found(texts, table.select("name", "rule"), text, keep=groups)
    # keywords of a plan's own dictionary
    counted = found.groupBy(*groups, "name").agg(F.count("*").alias("texts_")).join(F.broadcast(table), "name")
    sums = counted.groupBy(*groups).agg(*[F.sum(F.when(F.col("category") == c, F.col("texts_"))).alias(f"n_{c}") for c in categories])
    every = texts.select(*[F.col(g).alias(f"g_{g}") for g in groups]).distinct()
    on = F.lit(True)
    for g in groups:
        on = on & F.col(f"g_{g}").eqNullSafe(F.col(g))
    n = lambda c: F.coalesce(F.col(f"n_{c}"), F.lit(0))
    return every.join(sums, on, "left").select(*[F.col(f"g_{g}").alias(g) for g in groups], *[x for c in categories for x in ((n(c) > 0).alias(f"has_{c}"), n(c).alias(f"n_{c}"))])
