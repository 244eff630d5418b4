"""SQL of the ordered folds: recursion over the steps of a fold, all of its groups at once."""

from __future__ import annotations

from meridian.operators.ratings import CENTRE, CLOSE, NEW_PLAYER, TAU, UNIT, UNKNOWN
from meridian.sources.views import ENTRIES_SQL, PAIRINGS_SQL


def bound(value: str, name: str, body: str) -> str:
    """body with name for the value, which is computed once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def period(source: str) -> str:
    """source (r, rd, v, w, l, d and others) with r2, rd2, v2 after its games against unknown opponents; the root is narrowed 60 times at most.

    The search ends within a tolerance, so that its end depends on the last bits: operations come in the order of the operator's, in doubles.
    """
    unit, centre, spread = f"{UNIT}e0", f"{CENTRE}e0", f"{UNKNOWN[1] / UNIT}e0"
    both = lambda term: f"({term.format('w', 1.0)} + {term.format('l', 0.0)} + {term.format('d', 0.5)})"
    slope = lambda x: f"(exp({x}) * (excess - exp({x})) / (2 * pow(phi * phi + var + exp({x}), 2)) - ({x} - centre) / {TAU**2}e0)"
    low, high = "{{low: {0}, f_low: {1}, high: {2}, f_high: {3}}}".format, "coalesce(log_excess, centre - list_filter(range(1, 300), lambda k: " + slope(f"(centre - k * {TAU}e0)") + f" >= 0)[1] * {TAU}e0)"
    start = low("centre", slope("centre"), "top", slope("top"))
    narrowed = bound("s.low + (s.low - s.high) * s.f_low / (s.f_high - s.f_low)", "x", bound(slope("x"), "f", f"CASE WHEN f * s.f_high <= 0 THEN {low('s.high', 's.f_high', 'x', 'f')} ELSE {low('s.low', 's.f_low / 2', 'x', 'f')} END"))
    a = f"SELECT *, w + l + d AS n, (r - {centre}) / {unit} AS mu, rd / {unit} AS phi, 1 / sqrt(1 + 3 * {spread} * {spread} / pow(pi(), 2)) AS g FROM ({source})"
    b = f"SELECT *, 1 / (1 + exp(-g * (mu - {(UNKNOWN[0] - CENTRE) / UNIT}e0))) AS e FROM ({a})"
    c = f"SELECT *, 1 / {both('{0} * g * g * e * (1 - e)')} AS var, {both('{0} * g * ({1}e0 - e)')} AS gain, ln(v * v) AS centre FROM ({b})"
    x = f"SELECT *, CASE WHEN excess > 0 THEN ln(excess) END AS log_excess FROM (SELECT *, pow(var * gain, 2) - phi * phi - var AS excess FROM ({c}))"
    t = f"SELECT *, {start} AS first FROM (SELECT *, {high} AS top FROM ({x}))"
    found = f"list_reduce(list_transform(range(61), lambda i: first), lambda s, u: CASE WHEN abs(s.high - s.low) > {CLOSE} THEN {narrowed} ELSE s END).low"
    y = f"SELECT *, CASE WHEN n = 0 THEN v ELSE exp({found} / 2) END AS v2 FROM ({t})"
    z = f"SELECT *, CASE WHEN n = 0 THEN sqrt(phi * phi + v * v) ELSE 1 / sqrt(1 / (phi * phi + v2 * v2) + 1 / var) END AS phi2 FROM ({y})"
    return f"SELECT *, CASE WHEN n = 0 THEN r ELSE {centre} + {unit} * (mu + phi2 * phi2 * gain) END AS r2, {unit} * phi2 AS rd2 FROM ({z})"


_STATE = "CAST({} AS DOUBLE) AS r, CAST({} AS DOUBLE) AS rd, CAST({} AS DOUBLE) AS v".format

GLICKO = f"""WITH RECURSIVE {ENTRIES_SQL}, per AS (SELECT faction AS player, strftime(event_date, '%Y-%m') AS period, CAST(sum(wins) AS INT) AS w, CAST(sum(losses) AS INT) AS l, CAST(sum(draws) AS INT) AS d FROM entries WHERE event_date IS NOT NULL GROUP BY 1, 2),
steps AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY period) AS step FROM per),
f AS (SELECT DISTINCT player, CAST(NULL AS VARCHAR) AS period, CAST(0 AS BIGINT) AS step, CAST(NULL AS DOUBLE) AS before, {_STATE(*NEW_PLAYER)} FROM steps
UNION ALL SELECT player, period, step, r, r2, rd2, v2 FROM ({period("SELECT s.player, s.period, s.step, s.w, s.l, s.d, f.r, f.rd, f.v FROM f JOIN steps s ON s.player = f.player AND s.step = f.step + 1")}))
SELECT player, period, round(before, 6) AS before, round(r, 6) AS rating, round(rd, 6) AS deviation, round(v, 8) AS volatility, round(r - before, 6) AS delta FROM f WHERE step > 0"""


def imported(results: str, state: str) -> str:
    """state (player, rating, deviation, volatility, games, period) after the results (seq, player, faction, placement, wins, losses, draws) of an import."""
    source = f"SELECT p.*, coalesce(s.games, 0) AS had, {_STATE(*(f'coalesce(s.{c}, {x})' for c, x in zip(('rating', 'deviation', 'volatility'), NEW_PLAYER, strict=True)))}, p.wins AS w, p.losses AS l, p.draws AS d FROM p LEFT JOIN s ON lower(s.player) = lower(p.name) WHERE p.wins + p.losses + p.draws > 0"
    return f"""WITH s AS ({state}), p AS (SELECT *, coalesce(player, '[' || faction || '@' || placement || ']') AS name FROM ({results})),
new AS (SELECT lower(name) AS key, name, r2, rd2, v2, had + n AS games FROM ({period(source)}) QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY seq DESC) = 1)
SELECT coalesce(s.player, new.name) AS player, round(coalesce(r2, rating), 6) AS rating, round(coalesce(rd2, deviation), 6) AS deviation, round(coalesce(v2, volatility), 8) AS volatility, coalesce(new.games, s.games) AS games, CASE WHEN r2 IS NULL THEN s.period ELSE 'this' END AS period FROM s FULL JOIN new ON lower(s.player) = new.key"""


_PLAYED = "MAP {{{0}: {{'r': CAST(floor({1} + CASE WHEN {2} < 30 THEN 32 ELSE 16 END * ({3}) + 0.5) AS DOUBLE), 'k': CAST({2} + 1 AS BIGINT)}}}}".format

ELO = f"""WITH RECURSIVE {PAIRINGS_SQL}, games AS (SELECT event AS pool, p1, p2, CAST(CASE result WHEN 'P1' THEN 1.0 WHEN 'P2' THEN 0.0 ELSE 0.5 END AS DOUBLE) AS score, row_number() OVER (PARTITION BY event ORDER BY game) AS step FROM pairings WHERE p2 IS NOT NULL),
f AS (SELECT DISTINCT pool, CAST(0 AS BIGINT) AS step, CAST(MAP {{}} AS MAP(BIGINT, STRUCT(r DOUBLE, k BIGINT))) AS table_of FROM games
UNION ALL SELECT pool, step, map_concat(table_of, {_PLAYED("p1", "ra", "ka", "score - e")}, {_PLAYED("p2", "rb", "kb", "e - score")}) FROM (SELECT *, 1 / (1 + pow(10, (rb - ra) / 400)) AS e FROM (
  SELECT g.*, table_of, coalesce(table_of[p1].r, 1200) AS ra, coalesce(table_of[p1].k, 0) AS ka, coalesce(table_of[p2].r, 1200) AS rb, coalesce(table_of[p2].k, 0) + CAST(p1 = p2 AS INT) AS kb FROM f JOIN games g ON g.pool = f.pool AND g.step = f.step + 1)))
SELECT pool, e.key AS player, e.value.r AS rating, e.value.k AS games FROM (SELECT pool, unnest(map_entries(table_of)) AS e FROM (SELECT * FROM f QUALIFY step = max(step) OVER (PARTITION BY pool)))"""

STABILITY = """WITH RECURSIVE frames AS (SELECT user_id AS session, event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS found, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events),
f AS (SELECT DISTINCT session, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS found, CAST(0 AS BIGINT) AS step, 0 AS same, 0 AS pause, CAST(0 AS BIGINT) AS before, false AS caught FROM frames
UNION ALL SELECT session, seq, found, step, CASE WHEN pause > 0 THEN same WHEN caught OR NOT equal THEN 0 ELSE same + 1 END, CASE WHEN pause > 0 THEN pause - CAST(found = 0 AS INT) WHEN caught THEN 1 ELSE 0 END, CASE WHEN pause > 0 OR equal THEN before ELSE found END, caught FROM (
  SELECT *, pause = 0 AND equal AND same + 1 >= 2 AS caught FROM (SELECT x.*, f.same, f.pause, f.before, x.found <> 0 AND x.found = f.before AS equal FROM f JOIN frames x ON x.session = f.session AND x.step = f.step + 1)))
SELECT session, seq, found FROM f WHERE caught"""


def swiss(standings: str) -> str:
    """The draw over standings (event, player, place, wins, losses, draws) of the pairings, a bracket a step: a player of the upper half takes the one opposite, else the first free one, of those not met if there are any."""
    opposite = "CASE WHEN list_contains(s.free, ranked[half + u.i]) THEN [ranked[half + u.i]] ELSE [] END"
    wanted = f"coalesce(list_filter(list_concat({opposite}, s.free), lambda c: NOT list_contains(coalesce(met[ranked[u.i]], []), c))[1], s.free[1])"
    drawn = bound(wanted, "q", "{i: u.i, free: list_filter(s.free, lambda c: c <> q), games: list_append(s.games, {p1: ranked[u.i], p2: q})}")
    state = "{{i: CAST({0} AS BIGINT), free: {1}, games: {2}}}".format
    first, none = state("0", "ranked[half + 1 :]", "list_filter([{p1: CAST(0 AS BIGINT), p2: CAST(0 AS BIGINT)}], lambda x: false)"), state("i", "ranked[:0]", "list_filter([{p1: CAST(0 AS BIGINT), p2: CAST(0 AS BIGINT)}], lambda x: false)")
    return f"""WITH RECURSIVE st AS ({standings}), {PAIRINGS_SQL},
r AS (SELECT event, player, place, wins, min(place) OVER (PARTITION BY event, wins, losses, draws) AS first, count(*) OVER (PARTITION BY event) % 2 = 1 AND place = max(place) OVER (PARTITION BY event) AS bye FROM st),
b AS (SELECT event, list(player ORDER BY place) AS players, row_number() OVER (PARTITION BY event ORDER BY wins DESC, first) AS step FROM r WHERE NOT bye GROUP BY event, wins, first),
sides AS (SELECT event, p1 AS player, p2 AS other FROM pairings WHERE p2 IS NOT NULL UNION SELECT event, p2, p1 FROM pairings WHERE p2 IS NOT NULL),
m AS (SELECT event, map_from_entries(list({{k: player, v: others}})) AS met FROM (SELECT event, player, list(other) AS others FROM sides GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT DISTINCT event, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS free, CAST([] AS STRUCT(p1 BIGINT, p2 BIGINT)[]) AS games FROM r
UNION ALL SELECT event, step, done.free, list_concat(games, done.games) FROM (SELECT event, step, games, list_reduce(list_concat([{first}], list_transform(range(1, half + 1), lambda i: {none})), lambda s, u: {drawn}) AS done FROM (
  SELECT *, len(ranked) // 2 AS half FROM (SELECT b.event, b.step, f.games, list_concat(f.free, b.players) AS ranked, coalesce(m.met, MAP {{}}) AS met FROM f JOIN b ON b.event = f.event AND b.step = f.step + 1 LEFT JOIN m ON m.event = f.event)))),
last AS (SELECT event, unnest(games) AS g, generate_subscripts(games, 1) AS board FROM (SELECT * FROM f QUALIFY step = max(step) OVER (PARTITION BY event)))
SELECT event, CAST(board AS INT) AS board, g.p1 AS p1, g.p2 AS p2 FROM last UNION ALL SELECT event, 0, player, NULL FROM r WHERE bye"""
