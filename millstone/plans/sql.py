"""DuckDB SQL for digests that lose nothing, written from the rules of ``millstone.kernel``."""

from __future__ import annotations

from collections.abc import Sequence


def _on(keys: Sequence[str], a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys) or "true"


def points(table: str, keys: Sequence[str], value: str, weight: str = "1.0") -> str:
    """CTEs: p (distinct values m with weight w and centre c, neighbours m2, w2, c2), g (a row per group)."""
    names = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""
h AS (SELECT {names}CAST({value} AS DOUBLE) AS m, CAST(sum({weight}) AS DOUBLE) AS w FROM {table} GROUP BY {names}m),
s AS (SELECT *, sum(w) OVER ({part}ORDER BY m ROWS UNBOUNDED PRECEDING) AS e FROM h),
p AS (SELECT *, e - w / 2 AS c, lead(m) OVER o AS m2, lead(w) OVER o AS w2, lead(e - w / 2) OVER o AS c2 FROM s WINDOW o AS ({part}ORDER BY m)),
g AS (SELECT {names}sum(w) AS n, count(*) AS k, min(m) AS lo, max(m) AS hi, sum(m * w) AS total FROM h {group})"""


QUANTILE = """CASE WHEN g.k = 1 THEN g.lo WHEN i < 1 THEN g.lo WHEN i > g.n - 1 THEN g.hi WHEN p.m IS NULL THEN g.lo WHEN p.m2 IS NULL THEN g.hi
  WHEN p.w > 1 AND i - p.c < p.w / 2 THEN p.m WHEN p.w2 > 1 AND p.c2 - i < p.w2 / 2 THEN p.m2
  WHEN p.w = 1 AND i - p.c < 0.5 THEN p.m WHEN p.w2 = 1 AND p.c2 - i < 0.5 THEN p.m2
  WHEN (p.c2 - p.c) - (CASE WHEN p.w = 1 THEN 0.5 ELSE 0 END) - (CASE WHEN p.w2 = 1 THEN 0.5 ELSE 0 END) <= 0 THEN (p.m + p.m2) / 2
  ELSE (p.m * (p.c2 - i - (CASE WHEN p.w2 = 1 THEN 0.5 ELSE 0 END)) + p.m2 * (i - p.c - (CASE WHEN p.w = 1 THEN 0.5 ELSE 0 END)))
     / ((p.c2 - p.c) - (CASE WHEN p.w = 1 THEN 0.5 ELSE 0 END) - (CASE WHEN p.w2 = 1 THEN 0.5 ELSE 0 END)) END"""


def quantiles(
    table: str,
    keys: Sequence[str],
    value: str,
    probes: Sequence[float],
    *,
    weight: str = "1.0",
    with_: str = "",
    times: float = 1,
) -> str:
    """keys, q, value: a row per group and probe."""
    names = "".join(f"g.{k}, " for k in keys)
    listed = ", ".join(f"(CAST({q} AS DOUBLE))" for q in probes)
    return f"""WITH {with_}{points(table, keys, value, weight)},
f AS (SELECT g.*, q, q * n AS i FROM g, (VALUES {listed}) t(q))
SELECT {names}q, round({times} * ({QUANTILE}), 6) AS value
FROM f g LEFT JOIN p ON {_on(keys, "g", "p")} AND p.c <= g.i AND (p.c2 IS NULL OR p.c2 > g.i)"""


def medians(table: str, keys: Sequence[str], value: str) -> str:
    """keys, median."""
    names = "".join(f"g.{k}, " for k in keys)
    return f"""WITH {points(table, keys, value)},
f AS (SELECT g.*, 0.5 * n AS i FROM g),
x AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY {", ".join(keys) or "1"} ORDER BY m) = 1),
y AS (SELECT * FROM p WHERE m2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {", ".join(keys) or "1"} ORDER BY m DESC) = 1)
SELECT {names}round(CASE WHEN CAST(trunc(g.n) AS BIGINT) % 2 = 1 THEN {QUANTILE} WHEN g.k = 1 THEN g.lo
  WHEN g.k = 2 OR g.n <= 2 OR p.m IS NULL THEN (x.m + x.m2) / 2 WHEN p.m2 IS NULL THEN (y.m + y.m2) / 2 ELSE (p.m + p.m2) / 2 END, 6) AS median
FROM f g LEFT JOIN p ON {_on(keys, "g", "p")} AND p.c <= g.i AND (p.c2 IS NULL OR p.c2 > g.i)
LEFT JOIN x ON {_on(keys, "g", "x")} LEFT JOIN y ON {_on(keys, "g", "y")}"""


def cdfs(
    table: str, keys: Sequence[str], value: str, probes: Sequence[float], *, weight: str = "1.0", with_: str = ""
) -> str:
    """keys, x, share."""
    names = "".join(f"{k}, " for k in keys)
    listed = ", ".join(f"(CAST({x} AS DOUBLE))" for x in probes)
    return f"""{"WITH " + with_.rstrip().rstrip(",") if with_ else ""}
SELECT {names}x, round(sum({weight} * CASE WHEN {value} < x THEN 1.0 WHEN {value} = x THEN 0.5 ELSE 0 END) / sum({weight}), 6) AS share
FROM {table}, (VALUES {listed}) t(x) GROUP BY {names}x"""


def trimmed(table: str, keys: Sequence[str], value: str, lower: float, upper: float) -> str:
    """keys, trimmed."""
    names = "".join(f"{k}, " for k in keys)
    taken = f"greatest(0, least(p.e, {upper} * g.n) - greatest(p.e - p.w, {lower} * g.n))"
    return f"""WITH {points(table, keys, value)}
SELECT {"".join(f"g.{k}, " for k in keys)}round(sum(p.m * {taken}) / sum({taken}), 6) AS trimmed
FROM g JOIN p ON {_on(keys, "g", "p")} GROUP BY {names.replace(", ", ", ").rstrip(", ") if not keys else ", ".join(f"g.{k}" for k in keys)}"""


#: k(q) of a scale of size 1, of a share {q}.
SCALES = {
    "quad": "CASE WHEN {q} < 0.5 THEN sqrt({q} / 2) ELSE 1 - sqrt((1 - {q}) / 2) END",
    "k1": "asin(2 * {q} - 1) / (2 * pi())",
    "k2": "ln({q} / (1 - {q})) / (4 * ln(2))",
    "k3": "ln(greatest(ln(1 / (1 - {q})) / ln(1 / {q}), 1e-15)) / 4",
}


def _scaled(scale: str, share: str) -> str:
    return f"({SCALES[scale].format(q=f'least(greatest({share}, 1e-15), 1 - 1e-15)')})"


def _chain(name: str, lists: str, size: str) -> str:
    """CTE: the start (from 1) of each cluster of ``lists`` (k, gb, ga: k of a scale of size 1 before and after each
    point; n), for a size that is a column of it."""
    step = f"greatest(len(list_filter(f.ga, lambda x: x * {size} <= f.gb[c.pos] * {size} + 1 + 1e-12)) + 1, c.pos + 1)"
    return f"""{name} AS (WITH RECURSIVE c(k, pos) AS (SELECT k, CAST(1 AS BIGINT) FROM {lists} UNION ALL
  SELECT k, nxt FROM (SELECT c.k, CAST({step} AS BIGINT) AS nxt, f.n FROM c JOIN {lists} f ON c.k = f.k) WHERE nxt <= n) SELECT * FROM c)"""


def _lists(name: str, points_: str, scale: str, more: str = "") -> str:
    """CTE: the points of each group as lists, in the order of ``i``."""
    return f"""{name} AS (SELECT k, count(*) AS n{more}, list({_scaled(scale, "b / t")} ORDER BY i) AS gb, list({_scaled(scale, "e / t")} ORDER BY i) AS ga FROM
  (SELECT *, coalesce(lag(e) OVER (PARTITION BY k ORDER BY i), 0) AS b, max(e) OVER (PARTITION BY k) AS t FROM
    (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM {points_})) GROUP BY k)"""


def _grouped(name: str, points_: str, starts: str) -> str:
    """CTE: points summed by the clusters that start at ``starts``: k, i, m, w, a."""
    return f"""{name} AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY head) AS i, CASE WHEN count(*) = 1 THEN any_value(m) ELSE sum(m * w) / sum(w) END AS m, sum(w) AS w, count(*) = 1 AND bool_and(a) AS a
  FROM (SELECT p.*, max(c.pos) OVER (PARTITION BY p.k ORDER BY p.i ROWS UNBOUNDED PRECEDING) AS head FROM {points_} p LEFT JOIN {starts} c ON c.k = p.k AND c.pos = p.i) GROUP BY k, head)"""


def blended(source: str, size: int, scale: str = "k2", policy: str = "use", pin: int = 0, name: str = "d") -> str:
    """CTEs up to ``name`` (k, m, w, a): the centroids of each group of ``source``, a CTE or table of distinct points
    (k, m, w, a).

    The rules of the kernel: outer points are pinned; the others are clustered greedily, by a scale of the
    digest's size; where that leaves too many, by the largest size that does not, which is searched for by halving.
    """
    left, right = {
        "use": ("least(n, 1)", "CASE WHEN n > 1 THEN 1 ELSE 0 END"),
        "off": ("0", "0"),
        "edges": (f"least(n, {pin})", f"CASE WHEN n > 2 * {pin} THEN {pin} ELSE greatest(n - {pin}, 0) END"),
    }[policy]
    most = f"greatest({size} - ({left}) - ({right}), 1)" if policy == "use" else f"{size}"
    kept = f"n <= {size}" if policy == "off" else "false"
    x = f"{name}_"
    search = "greatest(len(list_filter(f.ga, lambda x: x * mid <= f.gb[r.pos] * mid + 1 + 1e-12)) + 1, r.pos + 1)"
    return f"""{x}o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY m) AS place, count(*) OVER (PARTITION BY k) AS n FROM {source}),
{x}p AS (SELECT *, {kept} OR place <= {left} OR place > n - ({right}) AS pinned, {most} AS most FROM {x}o),
{x}i AS (SELECT k, m, w, a, most, row_number() OVER (PARTITION BY k ORDER BY m) AS i FROM {x}p WHERE NOT pinned),
{_lists(x + "f", x + "i", scale)},
{_chain(x + "s", x + "f", str(float(size)))},
{_grouped(x + "c", x + "i", x + "s")},
{x}n AS (SELECT c.*, any_value(p.most) OVER (PARTITION BY c.k) AS most, count(*) OVER (PARTITION BY c.k) AS many FROM {x}c c JOIN (SELECT DISTINCT k, most FROM {x}p) p USING (k)),
{x}w AS (SELECT * FROM {x}n WHERE many > most),
{_lists(x + "h", x + "w", scale, ", any_value(most) AS most")},
{x}r AS (WITH RECURSIVE r(k, lo, hi, pos, seen) AS (SELECT k, CAST(0 AS DOUBLE), CAST({2 * size} AS DOUBLE), CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM {x}h UNION ALL
  SELECT k, CASE WHEN ended AND seen <= most THEN mid ELSE lo END, CASE WHEN over THEN mid ELSE hi END, CASE WHEN ended OR over THEN 1 ELSE nxt END, CASE WHEN ended OR over THEN 1 ELSE seen + 1 END FROM
    (SELECT *, nxt > n AS ended, CASE WHEN nxt > n THEN seen > most ELSE seen + 1 > most END AS over FROM
      (SELECT r.*, f.n, f.most, CAST({search} AS BIGINT) AS nxt FROM (SELECT *, (lo + hi) / 2 AS mid FROM r WHERE hi - lo > {size * 1e-9} AND lo < {size}) r JOIN {x}h f ON r.k = f.k)))
  SELECT k, lo FROM r WHERE NOT (hi - lo > {size * 1e-9} AND lo < {size})),
{x}g AS (SELECT h.*, greatest(r.lo, 1e-300) AS lo FROM {x}h h JOIN {x}r r USING (k)),
{_chain(x + "t", x + "g", "f.lo")},
{_grouped(x + "u", x + "w", x + "t")},
{name} AS (SELECT k, m, w, a FROM {x}p WHERE pinned UNION ALL SELECT k, m, w, a FROM {x}n WHERE many <= most UNION ALL SELECT k, m, w, a FROM {x}u)"""


def clusters(key: str, centroids: str = "d") -> str:
    """key, mean, weight, atomic of centroids. Means are moved a little before they are rounded, as many lie halfway
    between two decimals."""
    return f"SELECT k AS {key}, round(m + 0.000000123, 6) AS mean, w AS weight, a AS atomic FROM {centroids}"


def delta_clusters(source: str, delta: float, name: str = "d") -> str:
    """CTEs up to ``name``: the centroids of delta mode: greedy clusters by the scale k2norm over all points, without
    slack, pins or a cap."""
    x = f"{name}_"
    size = f"({delta} / (4 * ln(f.n / {delta}) + 24) * 4 * ln(2))"
    return f"""{x}i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY m) AS i FROM {source}),
{_lists(x + "f", x + "i", "k2")},
{_chain(x + "s", x + "f", size).replace(" + 1 + 1e-12", " + 1")},
{_grouped(name, x + "i", x + "s")}"""


def _neighbours(centroids: str) -> str:
    """CTEs: t (centroids with running weight, centre and the next one), z (a row per group; lo and hi from the
    source)."""
    return f"""t AS (SELECT k, m, w, a, e, e - w / 2 AS c, lead(m) OVER o AS m2, lead(w) OVER o AS w2, lead(a) OVER o AS a2, lead(e - w / 2) OVER o AS c2 FROM (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY m ROWS UNBOUNDED PRECEDING) AS e FROM {centroids}) WINDOW o AS (PARTITION BY k ORDER BY m)),
z AS (SELECT t.k, count(*) AS many, max(e) AS n, arg_min(m, m) AS m0, arg_min(w, m) AS w0, arg_min(a, m) AS a0, min(c) AS c0, arg_max(m, m) AS m9, arg_max(w, m) AS w9, arg_max(a, m) AS a9, max(c) AS c9, any_value(lo) AS lo, any_value(hi) AS hi
  FROM t JOIN (SELECT k, min(m) AS lo, max(m) AS hi FROM src GROUP BY k) s ON s.k = t.k GROUP BY t.k)"""


def blended_quantiles(ctes: str, key: str, probes: Sequence[float], centroids: str = "d") -> str:
    """key, q, value: quantiles of blended centroids, by the kernel's rules."""
    listed = ", ".join(f"(CAST({q} AS DOUBLE))" for q in probes)
    left, right = "(CASE WHEN w = 1 THEN 0.5 ELSE 0 END)", "(CASE WHEN w2 = 1 THEN 0.5 ELSE 0 END)"
    below, above = f"(i - c - {left})", f"(c2 - i - {right})"
    return f"""{ctes},
{_neighbours(centroids)},
v AS (SELECT z.*, q, q * n AS i FROM z, (VALUES {listed}) p(q))
SELECT v.k AS {key}, q, round(least(greatest(CASE WHEN many = 1 THEN m0 WHEN i < 1 THEN lo WHEN i > n - 1 THEN hi
  WHEN i < c0 THEN CASE WHEN a0 THEN m0 ELSE lo + (m0 - lo) * i / (w0 / 2) END
  WHEN i >= c9 THEN CASE WHEN a9 THEN m9 ELSE m9 + (hi - m9) * (i - c9) / (w9 / 2) END
  WHEN a AND w > 1 AND abs(i - c) < w / 2 THEN m WHEN a2 AND w2 > 1 AND abs(c2 - i) < w2 / 2 THEN m2
  WHEN w = 1 AND i - c < 0.5 THEN m WHEN w2 = 1 AND c2 - i < 0.5 THEN m2
  WHEN {below} + {above} <= 0 THEN (m + m2) / 2 ELSE (m * {above} + m2 * {below}) / ({below} + {above}) END, lo), hi), 6) AS value
FROM v LEFT JOIN t ON t.k = v.k AND t.c <= v.i AND t.c2 > v.i"""


def blended_cdfs(ctes: str, key: str, probes: Sequence[float], centroids: str = "d") -> str:
    """key, x, share: shares by blended centroids, by the kernel's rules."""
    listed = ", ".join(f"(CAST({x} AS DOUBLE))" for x in probes)
    at_left, at_right = "(CASE WHEN a THEN w / 2 ELSE 0 END)", "(CASE WHEN a2 THEN w2 / 2 ELSE 0 END)"
    return f"""{ctes},
{_neighbours(centroids)},
v AS (SELECT z.*, x FROM z, (VALUES {listed}) p(x))
SELECT v.k AS {key}, x, round(CASE WHEN x = m THEN (e - w / 2) / n
  WHEN x < m0 THEN CASE WHEN x < lo OR m0 <= lo THEN 0 WHEN x = lo THEN 0.5 / n ELSE (1 + (x - lo) / (m0 - lo) * (w0 / 2 - 1)) / n END
  WHEN x > m9 THEN CASE WHEN x > hi OR hi <= m9 THEN 1 WHEN x = hi THEN 1 - 0.5 / n ELSE 1 - (1 + (hi - x) / (hi - m9) * (w9 / 2 - 1)) / n END
  ELSE (e - w / 2 + {at_left} + (w / 2 + w2 / 2 - {at_left} - {at_right}) * (x - m) / (m2 - m)) / n END, 6) AS share
FROM v LEFT JOIN t ON t.k = v.k AND t.m <= v.x AND (t.m2 > v.x OR t.m2 IS NULL)"""


def k1_clusters(table: str, key: str, value: str, size: int) -> str:
    """The clusters of scale k1 over the points between a group's first and last: key, cluster, mean, weight.

    Each point's next cluster start is found by one join on k; the chain of starts is followed. Means are
    moved by 0.0000123 before they are rounded, as many lie halfway between two decimals.
    """
    k = f"{size} / (2 * pi()) * asin(2 * least(greatest({{q}}, 1e-15), 1 - 1e-15) - 1)"
    return f"""WITH {points(table, [key], value)},
r AS (SELECT {key}, m, w, row_number() OVER (PARTITION BY {key} ORDER BY m) AS i, count(*) OVER (PARTITION BY {key}) AS k FROM h),
z AS (SELECT {key}, m, w, i - 1 AS i, sum(w) OVER (PARTITION BY {key} ORDER BY m ROWS UNBOUNDED PRECEDING) AS e, sum(w) OVER (PARTITION BY {key}) AS n FROM r WHERE i > 1 AND i < k),
y AS (SELECT *, {k.format(q="(e - w) / n")} AS before, {k.format(q="e / n")} AS after FROM z),
j AS MATERIALIZED (SELECT a.{key}, a.i, greatest(b.i, a.i + 1) AS nxt FROM (SELECT {key}, i, before + 1 + 1e-12 AS top FROM y) a ASOF LEFT JOIN y b ON a.{key} = b.{key} AND a.top < b.after),
c AS (WITH RECURSIVE f({key}, i) AS (SELECT {key}, CAST(1 AS BIGINT) FROM g WHERE k > 2 UNION ALL SELECT j.{key}, j.nxt FROM f JOIN j ON f.{key} = j.{key} AND f.i = j.i WHERE j.nxt IS NOT NULL) SELECT * FROM f),
o AS (SELECT y.{key}, y.m, y.w, max(c.i) OVER (PARTITION BY y.{key} ORDER BY y.i ROWS UNBOUNDED PRECEDING) AS head FROM y LEFT JOIN c ON c.{key} = y.{key} AND c.i = y.i),
u AS (SELECT {key}, sum(m * w) / sum(w) AS mean, sum(w) AS weight FROM o GROUP BY {key}, head
      UNION ALL SELECT {key}, m, w FROM r WHERE i = 1 OR i = k)
SELECT {key}, round(mean + 0.0000123, 4) AS mean, weight FROM u"""
