"""Expected results of an attack as column expressions, and their distribution by simulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import parse

#: What a weapon's row holds of its abilities: their sums by type, or whether there is one.
SUMS = ("HIT_MOD", "WOUND_MOD", "ATTACKS_MOD", "STRENGTH_MOD", "TOUGHNESS_MOD", "SUSTAINED_HITS", "MELTA")
FLAGS = ("TORRENT", "BLAST", "LETHAL_HITS", "REROLL_HITS", "REROLL_HITS_OF_1", "REROLL_WOUNDS", "TWIN_LINKED", "DEVASTATING_WOUNDS")


def _total(kind: str) -> Column:
    return F.aggregate("abilities", F.lit(0), lambda acc, a: acc + F.when(a["type"] == kind, F.coalesce(a["value"], F.lit(0))).otherwise(0))


def _has(kind: str) -> Column:
    return F.exists("abilities", lambda a: a["type"] == kind)


def _clamp(x: Column) -> Column:
    return F.least(F.lit(6), F.greatest(F.lit(2), x))


def wound_target(strength: Column, toughness: Column) -> Column:
    return F.when(strength >= 2 * toughness, 2).when(strength > toughness, 3).when(strength == toughness, 4).when(2 * strength > toughness, 5).otherwise(6)


def weapons(rows: DataFrame) -> DataFrame:
    """Adds to weapons (attacks and damage as dice text, skill, strength, ap, abilities of parse.abilities) their dice and the sums and flags of their abilities; null abilities are none."""
    rows = rows.withColumn("abilities", F.coalesce("abilities", F.array().cast(f"array<{parse.ABILITY_TYPE}>")))
    return rows.withColumns({k.lower(): _total(k) for k in SUMS} | {k.lower(): _has(k) for k in FLAGS} | {"attack_dice": parse.dice(parse.dice_text(F.col("attacks"))), "damage_dice": parse.dice(parse.dice_text(F.col("damage")))})


def odds(rows: DataFrame) -> DataFrame:
    """Adds the chances of every roll to rows of a weapon (as weapons() gives it) and its target.

    Target: toughness, save, invuln and fnp (null: none), wounds, models, keywords (null: none). Call weapons() before a join with
    targets, so that texts are read once a weapon.
    """
    rows = rows.withColumn("keywords", F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda x: F.lower(x)))
    against = F.filter("abilities", lambda a: (a["type"] == "ANTI") & F.array_contains(F.col("keywords"), F.lower(a["keyword"])))
    target = _clamp(wound_target(F.col("strength") + F.col("strength_mod"), F.greatest(F.lit(1), F.col("toughness") + F.col("toughness_mod"))) - F.col("wound_mod"))
    save = F.least(F.lit(7), F.col("save") - F.col("ap"), F.col("invuln"))
    rows = rows.withColumns({
        "hit": (7 - _clamp(F.col("skill") - F.col("hit_mod"))) / 6, "wound": (7 - F.least(target, F.array_min(F.transform(against, lambda a: a["value"])))) / 6,
        "through": 1 - F.greatest(F.lit(0), 7 - save) / 6, "unhurt": F.when(F.col("fnp") <= 6, (7 - F.col("fnp")) / 6).otherwise(0.0),
    })
    # A die thrown again multiplies every outcome by one plus the chance of that throw.
    hits = 1 + F.when(F.col("reroll_hits"), 1 - F.col("hit")).when(F.col("reroll_hits_of_1"), F.lit(1 / 6)).otherwise(0.0)
    wounds = 1 + F.when(F.col("reroll_wounds") | F.col("twin_linked"), 1 - F.col("wound")).otherwise(0.0)
    return rows.withColumns({"hit": F.col("hit") * hits, "hit_six": hits / 6, "wound": F.col("wound") * wounds, "wound_six": wounds / 6})


def number_of_attacks(n: Column) -> Column:
    """Blast gives at least three against six models; a change of the number leaves at least one."""
    n = F.when(F.col("blast") & (F.col("models") >= 6), F.greatest(n, F.lit(3.0))).otherwise(n)
    return F.when(F.col("attacks_mod") != 0, F.greatest(F.lit(1.0), n + F.col("attacks_mod"))).otherwise(n)


def expected(rows: DataFrame) -> DataFrame:
    """Adds the expected hits, wounds, damage, models removed and survivors, and the wounds of the best and the worst case."""
    n, rest = F.col("n_attacks"), lambda p, six: F.greatest(F.lit(0.0), F.col(p) - F.col(six))
    rows = odds(rows).withColumn("n_attacks", number_of_attacks(parse.dice_mean(F.col("attack_dice")).cast("double")))
    straight = F.when(F.col("lethal_hits"), n * rest("hit", "hit_six")).otherwise(n * F.col("hit")) + n * F.col("hit_six") * F.col("sustained_hits")
    rows = rows.withColumns({"hits": F.when(F.col("torrent"), n).otherwise(straight), "lethal": F.when(F.col("lethal_hits") & ~F.col("torrent"), n * F.col("hit_six")).otherwise(0.0)})
    rows = rows.withColumns({
        "saveable": F.col("hits") * F.when(F.col("devastating_wounds"), rest("wound", "wound_six")).otherwise(F.col("wound")) + F.col("lethal"),
        "mortal": F.when(F.col("devastating_wounds"), F.col("hits") * F.col("wound_six")).otherwise(0.0),
    })
    dealt = (F.col("saveable") * F.col("through") + F.col("mortal")) * (1 - F.col("unhurt")) * (parse.dice_mean(F.col("damage_dice")) + F.col("melta"))
    passing, pool = F.col("through") * (1 - F.col("unhurt")), F.col("models") * F.col("wounds")
    tidy = lambda x: F.round(F.round(x, 9), 4)  # noqa: E731  (first to nine places, so that a tie is one in any order of sums)
    rows = rows.withColumns({
        "expected_wounds": tidy(dealt), "expected_removed": tidy(F.least(F.col("models"), dealt / F.col("wounds"))), "survivors": tidy(F.greatest(F.lit(0.0), F.col("models") - dealt / F.col("wounds"))),
        "best": F.least(n * passing * (parse.dice_most(F.col("damage_dice")) + F.col("melta")), pool), "worst": F.least(passing * (parse.dice_least(F.col("damage_dice")) + F.col("melta")), pool),
    })
    return rows.withColumns({"best_removed": F.floor(F.col("best") / F.col("wounds")), "worst_removed": F.floor(F.col("worst") / F.col("wounds")), "best": tidy(F.col("best")), "worst": tidy(F.col("worst"))})


_NUMBERS = ("hit", "hit_six", "wound", "wound_six", "through", "unhurt", "sustained_hits", "melta", "attacks_mod", "models", "wounds", "blast", "torrent", "lethal_hits", "devastating_wounds")
_DICE = [f"{d}_{i}" for d in "ad" for i in ("count", "sides", "plus")]
#: Chances below this are rounding errors of a Fourier transform; values of a law that are worked on at once.
_ROUNDING, _AT_ONCE = 1e-16, 2**20


def _throws(count: int, sides: int, plus: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of dice and their chances; at least 1 where dice are thrown."""
    if not count or not sides:
        return np.array([plus]), np.ones(1)
    chances = np.ones(1)
    for _ in range(count):
        chances = np.convolve(chances, np.full(sides, 1 / sides))
    return np.maximum(1, count + plus + np.arange(len(chances))), chances


def _attacks(count: int, sides: int, plus: int, three: int, mod: int) -> np.ndarray:
    """Chance of each number of attacks; three: blast against six models."""
    n, chances = _throws(count, sides, plus)
    n = np.maximum(n, 3) if three else n
    return np.bincount(np.maximum(1, n + mod) if mod else np.maximum(n, 0), chances)


def _hurts(count: int, sides: int, plus: int, melta: int) -> np.ndarray:
    """Chance of each damage of one wound."""
    n, chances = _throws(count, sides, plus)
    return np.bincount(np.maximum(0, n + melta), chances)


def _kinds(law, *columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The laws of the different rows of the columns, and which of them each row has."""
    groups = pd.DataFrame(np.stack(columns, 1).astype(np.int64)).groupby(list(range(len(columns))))
    return [law(*map(int, k)) for k in groups.size().index], groups.ngroup().to_numpy()


def _substituted(laws: list[np.ndarray], which: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Each row's generating function at the row's values z."""
    out = np.empty_like(z)
    for k, law in enumerate(laws):
        rows = np.flatnonzero(which == k)
        total = np.zeros_like(z[rows])
        for c in law[::-1]:
            total = total * z[rows] + c
        out[rows] = total
    return out


def _laws(c: dict[str, np.ndarray], attacks: tuple, hurts: tuple, size: int) -> np.ndarray:
    """Chance of each damage of a weapon in one round, a row each, from its generating function at size roots of unity; size is above any damage.

    Attacks of a round are independent, so the function of their sum is that of one attack put into that of their number.
    """
    col = lambda name: c[name].astype(float)[:, None]
    z = np.exp(-2j * np.pi * np.arange(size // 2 + 1) / size)[None, :]
    point = col("unhurt") + (1 - col("unhurt")) * z  # a point of damage that may be ignored
    saved = 1 - col("through") + col("through") * _substituted(*hurts, np.broadcast_to(point, (len(c["hit"]), z.shape[1])))
    wound, six = np.minimum(1, col("wound")), np.minimum(col("wound_six"), col("wound"))
    mortal = six * (point - saved) * col("devastating_wounds")
    hit = 1 - wound + wound * saved + mortal
    p = np.minimum(1, col("hit"))
    six = np.where(col("lethal_hits") + col("sustained_hits") > 0, np.minimum(col("hit_six"), p), 0)
    more = np.ones_like(hit)
    for i in range(int(c["sustained_hits"].max(initial=0))):
        more = np.where(col("sustained_hits") > i, more * hit, more)
    attack = 1 - p + (p - six) * hit + six * np.where(col("lethal_hits") > 0, saved, hit) * more
    found = np.fft.irfft(_substituted(*attacks, np.where(col("torrent") > 0, hit, attack)), size)
    found = np.where(found < _ROUNDING, 0, found)
    most = np.minimum(c["models"] * c["wounds"], size - 1).astype(np.int64)
    over = np.arange(size) > most[:, None]
    found[np.arange(len(most)), most] += (found * over).sum(1)
    found[over] = 0
    return found[:, : most.max(initial=0) + 1]


def _added(group: np.ndarray, low: np.ndarray, laws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Laws of the sums of neighbours in a group, pair by pair until each group has one; a row's law begins at its low. Equal groups stand together."""
    while len(group) > 1 and (group[1:] == group[:-1]).any():
        place = np.arange(len(group)) - np.searchsorted(group, group)
        first = np.flatnonzero(place % 2 == 0)
        paired = np.append(group[1:] == group[:-1], False)[first]
        left, width = first[paired], 2 * laws.shape[1] - 1
        size = 1 << (width - 1).bit_length()
        out = np.zeros((len(first), width))
        out[paired] = np.fft.irfft(np.fft.rfft(laws[left], size) * np.fft.rfft(laws[left + 1], size), size)[:, :width]
        out[~paired, : laws.shape[1]] = laws[first[~paired]]
        out[out < _ROUNDING] = 0
        skip = (out > 0).argmax(1)
        kept = width - (out[:, ::-1] > 0).argmax(1) - skip
        at = skip[:, None] + np.arange(kept.max())
        laws = np.where(at < width, np.take_along_axis(out, np.minimum(at, width - 1), 1), 0)
        laws /= laws.sum(1, keepdims=True)
        total = low[first]
        total[paired] += low[left + 1]
        group, low = group[first], total + skip
    return group, low, laws


def simulate(rows: DataFrame, keys: list[str], weapon: str, iterations: int = 5000, seed: int = 0, slice_size: int = 1000) -> DataFrame:
    """keys, damage, n: how often the weapons of a key (told apart by weapon) deal a total of damage.

    The rounds of a key are alike and independent, so each is drawn from the law of their total, slice_size at once: a weapon's law is exact,
    and the laws of a key's weapons are added up to rounding errors. So the rounds cost no throws of single dice. A key's weapons meet in
    one task, which holds a batch of them and their sum so far. Every slice has a seed of its own, so that a task run again gives the same
    totals. Mortal wounds deal one damage each.
    """
    p = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dice = [F.col(f"{d}_dice")[i].alias(f"{d[0]}_{i}") for d in ("attack", "damage") for i in ("count", "sides", "plus")]
    chances = odds(rows).select(*keys, *_NUMBERS, *dice, F.col(weapon).alias("__weapon"))
    chances = chances.withColumns({"__key": F.xxhash64(*keys, *(F.col(k).isNull() for k in keys), F.lit(seed)), "__weapon": F.xxhash64("__weapon", *_NUMBERS, *_DICE)})
    chances = chances.repartition(p, *keys).sortWithinPartitions(*keys, "__weapon")

    def drawn(key: tuple, number: int, low: int, law: np.ndarray) -> pd.DataFrame:
        up_to = law.cumsum()
        n = np.zeros(len(law), np.int64)
        for start in range(0, iterations, slice_size):
            at = np.random.default_rng([number % 2**64, start]).random(min(slice_size, iterations - start)) * up_to[-1]
            n += np.bincount(np.searchsorted(up_to, at, side="right"), minlength=len(law))
        found = np.flatnonzero(n)
        return pd.DataFrame({k: pd.Series([v] * len(found), dtype=object if v is None else None) for k, v in zip(keys, key, strict=True)} | {"damage": low + found, "n": n[found]})

    def rounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the key that may go on in the next rows: its values, its number, and the law of its total so far
        for batch in batches:
            c = {name: batch[name].to_numpy() for name in (*_NUMBERS, *_DICE)}
            attacks = _kinds(_attacks, c["a_count"], c["a_sides"], c["a_plus"], c["blast"] & (c["models"] >= 6), c["attacks_mod"])
            hurts = _kinds(_hurts, c["d_count"], c["d_sides"], c["d_plus"], c["melta"])
            most = lambda kind: np.array([len(law) - 1 for law in kind[0]], np.int64)[kind[1]]
            size = 1 << int((most(attacks) * (1 + c["sustained_hits"].astype(np.int64)) * np.maximum(1, most(hurts))).max(initial=1)).bit_length()
            number, step = batch["__key"].to_numpy(), max(16, _AT_ONCE // size)
            for i in range(0, len(batch), step):
                here = slice(i, i + step)
                laws = _laws({name: v[here] for name, v in c.items()}, (attacks[0], attacks[1][here]), (hurts[0], hurts[1][here]), size)
                numbers, low = number[here], np.zeros(len(laws), np.int64)
                names = list(batch[keys].iloc[here].astype(object).where(batch[keys].iloc[here].notna(), None).itertuples(index=False, name=None))
                if held:
                    width = max(laws.shape[1], len(held[3]))
                    laws = np.vstack([np.pad(held[3], (0, width - len(held[3])))[None, :], np.pad(laws, ((0, 0), (0, width - laws.shape[1])))])
                    names, numbers, low = [held[0], *names], np.append(held[1], numbers), np.append(held[2], low)
                group = np.append(0, (numbers[1:] != numbers[:-1]).cumsum())
                first = np.searchsorted(group, np.arange(group[-1] + 1))
                _, low, laws = _added(group, low, laws)
                done = [(names[f], int(numbers[f]), int(low[k]), np.trim_zeros(laws[k], "b")) for k, f in enumerate(first)]
                held = done.pop()
                if done:
                    yield pd.concat([drawn(*x) for x in done])
        if held:
            yield drawn(*held)

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return chances.mapInPandas(rounds, f"{schema}, damage long, n long")


def summary(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and percentiles of a histogram (keys, damage, n); a percentile is the value at position floor(n * p), from 0."""
    up_to, every = Window.partitionBy(*keys).orderBy("damage"), Window.partitionBy(*keys)
    rows = histogram.withColumns({"below": F.sum("n").over(up_to), "all": F.sum("n").over(every)})
    at = lambda p: F.min(F.when(F.col("below") > F.floor(F.col("all") * p), F.col("damage")))
    return rows.groupBy(*keys).agg(F.sum("n").alias("iterations"), F.round(F.sum(F.col("n") * F.col("damage")) / F.sum("n"), 6).alias("mean"), *(at(p).alias(name) for name, p in (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))))
