"""The same queries as plain SQL, to be run by another engine on the same files."""

from __future__ import annotations

import re

# Directed cluster pairs with the mate of both ends: a cluster's mate is its nearest one if that is mutual.
_MATES = """SELECT *, max(w) FILTER (w = fc AND fw = c) OVER (PARTITION BY step, c) AS mc, max(c) FILTER (c = fw AND fc = w) OVER (PARTITION BY step, w) AS mw,
    max(nw) FILTER (w = fc AND fw = c) OVER (PARTITION BY step, c) AS kc, max(nc) FILTER (c = fw AND fc = w) OVER (PARTITION BY step, w) AS kw
    FROM (SELECT *, first_value(w) OVER (PARTITION BY step, c ORDER BY d, least(c, w), greatest(c, w)) AS fc,
    first_value(c) OVER (PARTITION BY step, w ORDER BY d, least(c, w), greatest(c, w)) AS fw FROM {})"""


CTES: dict[str, str] = {
    "ab": """SELECT l_partkey AS entity, s_nationkey AS site, sum(l_quantity) AS abundance
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "cut": "SELECT * FROM ab WHERE abundance >= 20",
    "dim": """SELECT p_partkey AS entity, p_name AS name,
        CASE WHEN p_size <= 25 THEN 'Bacteria' ELSE 'Archaea' END AS kingdom, p_brand AS phylum,
        CASE WHEN p_type = 'SMALL' THEN '' ELSE p_type END AS class,
        split_part(p_name, ' ', 1) AS ord_rank, split_part(p_name, ' ', 2) AS family,
        CASE WHEN p_size % 5 = 0 THEN '' ELSE 'g' || p_size END AS genus,
        CASE WHEN p_size % 3 = 0 THEN '' ELSE 's' || p_size END AS species,
        CAST(p_size AS DOUBLE) * 2 AS completeness, CAST(p_size AS DOUBLE) / 10 AS contamination,
        p_partkey + 1000 AS size, p_brand || ', ' || CASE WHEN p_type = 'SMALL' THEN 'unknown class' ELSE p_type END AS label
        FROM part""",
    "sites": """SELECT n_nationkey AS site, n_name AS code, CASE WHEN n_nationkey % 2 = 0 THEN 'F' ELSE 'S' END AS type,
        r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "ann": """SELECT l_orderkey AS entity, l_linenumber AS gene_id, p_brand AS marker
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "annp": """SELECT l_partkey AS entity, l_orderkey AS gene_id,
        l_linenumber || l_returnflag || l_linestatus AS marker FROM lineitem""",
    "sc": """SELECT entity, disc / (n * 10) AS cbb, p_size / CAST(50 AS DOUBLE) AS rtca, f / n AS tca, tax / (n * 7) AS wl,
        r / n AS sulfide, a / n AS thiosulfate, nn / n AS nitrate FROM (
          SELECT l_partkey AS entity, CAST(count(*) AS DOUBLE) AS n,
            CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS disc,
            CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS tax,
            CAST(count(*) FILTER (l_returnflag = 'A') AS DOUBLE) AS a,
            CAST(count(*) FILTER (l_returnflag = 'N') AS DOUBLE) AS nn,
            CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS r,
            CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) AS f
          FROM lineitem GROUP BY 1) JOIN part ON entity = p_partkey""",
    "cand": """SELECT *, CASE WHEN cbb >= 0.6 OR (rtca >= 1 AND tca >= 0.5) OR wl >= 0.6 THEN 'autotroph'
        WHEN cbb < 0.6 AND (rtca < 1 OR tca < 0.5) AND wl < 0.6 THEN 'heterotroph' END AS candidate FROM sc""",
    "ev": """SELECT entity, bool_or(marker = '1RF') AS cbb_ev,
        bool_or(marker IN ('2AF', '3NO')) AND bool_or(marker IN ('4RO', '5AF')) AS wl_ev,
        (bool_or(marker = '1AF') AND bool_or(marker = '2AF')) OR bool_or(marker = '7NO') AS h_ev,
        bool_or(marker = '6RF') AS aero_ev, bool_or(marker = '3RF') AND bool_or(marker = '4RF') AS micro_ev
        FROM annp GROUP BY 1""",
    "fl": """SELECT c.entity, candidate, CAST(candidate = 'autotroph' AND cbb_ev AS INTEGER) AS cbb_p,
        CAST(candidate = 'autotroph' AND rtca = 1 AS INTEGER) AS rtca_p,
        CAST(candidate = 'autotroph' AND wl_ev AS INTEGER) AS wl_p,
        CAST(h_ev AS INTEGER) AS h, CAST(thiosulfate >= 0.4 OR sulfide > 0.45 AS INTEGER) AS so,
        CAST(sulfide > 0.4 AS INTEGER) AS sr, CAST(nitrate > 0.4 AS INTEGER) AS nr,
        CAST(micro_ev AS INTEGER) AS micro, CAST(aero_ev AS INTEGER) AS aero
        FROM cand c JOIN ev USING (entity)""",
    "redox": """SELECT entity, 'Hydrogen Oxidation' AS trait, 'donor' AS kind, h AS value FROM fl
        UNION ALL SELECT entity, 'Sulfur Oxidation*', 'donor', so FROM fl
        UNION ALL SELECT entity, 'Sulfur Reduction', 'acceptor', sr FROM fl
        UNION ALL SELECT entity, 'Nitrogen Reduction*', 'acceptor', nr FROM fl
        UNION ALL SELECT entity, 'Microaerobic', 'acceptor', micro FROM fl
        UNION ALL SELECT entity, 'Aerobic', 'acceptor', aero FROM fl""",
    "fix": """SELECT entity, 'CBB.present' AS trait, 'fixation' AS kind, cbb_p AS value FROM fl
        UNION ALL SELECT entity, 'rTCA.present', 'fixation', rtca_p FROM fl
        UNION ALL SELECT entity, 'Wood.Ljungdahl.present', 'fixation', wl_p FROM fl""",
    "troph": """SELECT entity, 'Autotrophy' AS trait, 'trophic' AS kind, greatest(cbb_p, rtca_p, wl_p) AS value FROM fl
        UNION ALL SELECT entity, 'Heterotrophy', 'trophic', 1 - greatest(cbb_p, rtca_p, wl_p) FROM fl""",
    "traits": "SELECT * FROM redox UNION ALL SELECT * FROM fix UNION ALL SELECT * FROM troph",
    "members": """SELECT entity, trait AS metabolism FROM redox WHERE value > 0
        UNION ALL SELECT entity, trait FROM fix WHERE value > 0""",
    "fixers": "SELECT entity, trait AS pathway FROM fix WHERE value > 0",
    "comm": "SELECT p_partkey AS entity, CASE WHEN p_size <= 20 THEN 'prevalent' ELSE 'regional' END AS community FROM part",
    "cov": """SELECT n_nationkey AS site, c_bal, n_cust, n_rich, s_bal, n_supp, o_price FROM nation
        LEFT JOIN (SELECT c_nationkey, avg(c_acctbal) AS c_bal, CAST(count(*) AS DOUBLE) AS n_cust,
          CAST(count(*) FILTER (c_acctbal > 9900) AS DOUBLE) AS n_rich FROM customer GROUP BY 1) c
          ON c.c_nationkey = n_nationkey
        LEFT JOIN (SELECT s_nationkey, avg(s_acctbal) AS s_bal, CAST(count(*) AS DOUBLE) AS n_supp
          FROM supplier GROUP BY 1) s ON s.s_nationkey = n_nationkey
        LEFT JOIN (SELECT c_nationkey, avg(o_totalprice) AS o_price FROM orders JOIN customer ON o_custkey = c_custkey
          GROUP BY 1) o ON o.c_nationkey = n_nationkey""",
    "grid": """SELECT p_partkey AS entity, n_nationkey AS site, coalesce(abundance, 0) AS a FROM part CROSS JOIN nation
        LEFT JOIN cut ON entity = p_partkey AND site = n_nationkey""",
    "srank": """SELECT entity, site, rank() OVER (PARTITION BY site ORDER BY a)
        + (count(*) OVER (PARTITION BY site, a) - 1) / CAST(2 AS DOUBLE) AS r FROM grid""",
    "srho": """SELECT x.site AS site_a, y.site AS site_b, corr(x.r, y.r) AS rho FROM srank x JOIN srank y USING (entity)
        GROUP BY 1, 2""",
    "known": "SELECT site FROM srank GROUP BY 1 HAVING min(r) < max(r)",
    "sprof": "SELECT * FROM srho WHERE site_a IN (SELECT site FROM known) AND site_b IN (SELECT site FROM known)",
    "sdist": """SELECT x.site_a AS a, y.site_a AS b, sqrt(sum((x.rho - y.rho) * (x.rho - y.rho))) AS d
        FROM sprof x JOIN sprof y ON x.site_b = y.site_b AND x.site_a < y.site_a GROUP BY 1, 2""",
    "lk": """SELECT 0 AS step, a, b, d FROM sdist UNION ALL
        SELECT step + 1, least(x, y), greatest(x, y), max(d) FROM (
          SELECT step, d, CASE WHEN a = mb THEN ma ELSE a END AS x, CASE WHEN b = mb THEN ma ELSE b END AS y FROM (
            SELECT *, first_value(a) OVER (ORDER BY d, a, b) AS ma, first_value(b) OVER (ORDER BY d, a, b) AS mb FROM lk))
        WHERE x <> y GROUP BY 1, 2, 3""",
    "mg": """SELECT step + 1 AS step, a, b, d FROM (
        SELECT *, row_number() OVER (PARTITION BY step ORDER BY d, a, b) AS rn FROM lk) WHERE rn = 1""",
    "lo": """SELECT CAST(0 AS BIGINT) AS step, site AS c, CAST(site AS VARCHAR) AS items, CAST(-1 AS BIGINT) AS formed FROM known
        UNION ALL SELECT lo.step + 1, CASE WHEN c = m.b THEN m.a ELSE c END, string_agg(items, ',' ORDER BY formed, c),
        CASE WHEN count(*) > 1 THEN lo.step + 1 ELSE max(formed) END FROM lo JOIN mg m ON m.step = lo.step + 1 GROUP BY 1, 2""",
    "erank": """SELECT entity, site, rank() OVER (PARTITION BY entity ORDER BY a)
        + (count(*) OVER (PARTITION BY entity, a) - 1) / CAST(2 AS DOUBLE) AS r FROM grid
        WHERE entity IN (SELECT entity FROM grid GROUP BY 1 HAVING min(a) < max(a))""",
    "ez": """SELECT entity, key, list_transform(c, lambda x: x / n) AS z, min(entity) OVER (PARTITION BY key) AS rep FROM (
        SELECT entity, key, c, sqrt(list_inner_product(c, c)) AS n FROM (
        SELECT entity, list(r ORDER BY site) AS key, list(r - 13 ORDER BY site) AS c FROM erank GROUP BY 1))""",
    "em": """SELECT list(row_ ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS row_ FROM (
        SELECT x.i AS i, y.i AS j, sum(x.v * y.v) AS v FROM (SELECT entity, unnest(z) AS v, generate_subscripts(z, 1) AS i FROM ez) x
        JOIN (SELECT entity, unnest(z) AS v, generate_subscripts(z, 1) AS i FROM ez) y USING (entity) GROUP BY 1, 2) GROUP BY 1)""",
    "ey": """SELECT entity, z, y, list_inner_product(z, y) AS q, n FROM (
        SELECT entity, z, list_transform(m, lambda row_: list_inner_product(row_, z)) AS y,
        count(*) OVER (PARTITION BY rep) AS n, rep FROM ez, em) WHERE entity = rep""",
    "el": f"""SELECT 0 AS step, x.entity AS c, y.entity AS w, sqrt(greatest(x.q + y.q - 2 * list_inner_product(x.z, y.y), 0)) AS d,
        x.n AS nc, y.n AS nw FROM ey x JOIN ey y ON x.entity <> y.entity UNION ALL
        SELECT step + 1, c2, w2, max(d), max(nc2), max(nw2) FROM (
        SELECT step, d, least(c, mc) AS c2, least(w, mw) AS w2, nc + coalesce(kc, 0) AS nc2, nw + coalesce(kw, 0) AS nw2
        FROM ({_MATES.format("el")})) WHERE c2 <> w2 GROUP BY 1, 2, 3""",
    "em2": f"""SELECT c AS a, w AS b, d, nc + nw AS n FROM ({_MATES.format("el")}) WHERE mc = w AND c < w
        UNION ALL SELECT rep, entity, CAST(0 AS DOUBLE), 1 + row_number() OVER (PARTITION BY rep ORDER BY entity) FROM ez WHERE entity <> rep""",
    "ecut": """SELECT entity, entity AS at_ FROM ez UNION ALL
        SELECT ecut.entity, a FROM ecut JOIN em2 ON b = at_ WHERE d <= 10.0""",
    "eroot": "SELECT entity, CAST(dense_rank() OVER (ORDER BY root) AS INTEGER) AS cluster FROM (SELECT entity, min(at_) AS root FROM ecut GROUP BY 1)",
    "covf": "SELECT site, "
    + ", ".join(f"coalesce({c}, (SELECT avg({c}) FROM cov)) AS {c}" for c in ("c_bal", "n_cust", "n_rich", "s_bal", "n_supp", "o_price"))
    + " FROM cov",
    "pp": "SELECT site, entity, abundance / (SELECT sum(abundance) FROM cut) AS p FROM cut",
    "rw": "SELECT site, sum(p) AS r FROM pp GROUP BY 1",
    "cw": "SELECT entity, sum(p) AS c FROM pp GROUP BY 1",
    "xw": """SELECT site, r, s_bal - sum(r * s_bal) OVER () AS x1, o_price - sum(r * o_price) OVER () AS x2,
        n_cust - sum(r * n_cust) OVER () AS x3 FROM rw JOIN covf USING (site)""",
    "gg": """SELECT sum(r * x1 * x1) AS g11, sum(r * x1 * x2) AS g12, sum(r * x2 * x2) AS g22, sum(r * x1 * x3) AS g13,
        sum(r * x2 * x3) AS g23, sum(r * x3 * x3) AS g33 FROM xw""",
    "hh": """SELECT entity, sum(p * x1) / sqrt(any_value(c)) AS h1, sum(p * x2) / sqrt(any_value(c)) AS h2
        FROM pp JOIN xw USING (site) JOIN cw USING (entity) GROUP BY 1""",
    "inert": "SELECT sum(p * p / (r * c)) - 1 AS total FROM pp JOIN rw USING (site) JOIN cw USING (entity)",
    "eig": """SELECT *, (tr + sqrt(tr * tr - 4 * det)) / 2 AS l1, (tr - sqrt(tr * tr - 4 * det)) / 2 AS l2 FROM (
        SELECT *, (g22 * s11 - g12 * s12) / dg AS m11, (g22 * s12 - g12 * s22) / dg AS m12,
        (g22 * s11 - 2 * g12 * s12 + g11 * s22) / dg AS tr, (s11 * s22 - s12 * s12) / dg AS det FROM (
        SELECT *, g11 * g22 - g12 * g12 AS dg FROM gg CROSS JOIN (
        SELECT sum(h1 * h1) AS s11, sum(h1 * h2) AS s12, sum(h2 * h2) AS s22 FROM hh)))""",
    "ax": """SELECT axis, l, b1 * s / norm AS a1, b2 * s / norm AS a2 FROM (
        SELECT *, sqrt(g11 * b1 * b1 + 2 * g12 * b1 * b2 + g22 * b2 * b2) AS norm,
        sign(CASE WHEN abs(sqrt(g11) * b1) >= abs(sqrt(g22) * b2) THEN b1 ELSE b2 END) AS s FROM (
        SELECT 1 AS axis, l1 AS l, m12 AS b1, l1 - m11 AS b2, g11, g12, g22 FROM eig
        UNION ALL SELECT 2, l2, m12, l2 - m11, g11, g12, g22 FROM eig))""",
    "esc": """SELECT entity, axis, l, (h1 * a1 + h2 * a2) / sqrt(l) / sqrt(c) AS v FROM hh JOIN cw USING (entity) CROSS JOIN ax""",
    "ssc": """SELECT pp.site, axis, l, sum(p * v) / sum(p) AS u FROM pp JOIN esc USING (entity) GROUP BY 1, 2, 3""",
    "kern": """SELECT a.site AS i, b.site AS k, sum(a.p * b.p / c) AS v FROM pp a JOIN pp b USING (entity) JOIN cw USING (entity)
        GROUP BY 1, 2""",
    "perms": """SELECT perm, s.site, t.s_bal AS y1, t.o_price AS y2 FROM (SELECT perm, site, row_number() OVER (
        PARTITION BY perm ORDER BY CASE WHEN perm = 0 THEN lpad(CAST(site AS VARCHAR), 9, '0')
        ELSE md5('7|' || perm || '|' || site) END) AS pos FROM rw CROSS JOIN (SELECT unnest(range(0, 10000)) AS perm)) o
        JOIN (SELECT site, row_number() OVER (ORDER BY site) AS pos FROM rw) s USING (pos) JOIN covf t ON t.site = o.site""",
    "permx": """SELECT perm, site, r, y1 - sum(r * y1) OVER (PARTITION BY perm) AS x1,
        y2 - sum(r * y2) OVER (PARTITION BY perm) AS x2 FROM perms JOIN rw USING (site)""",
    "permg": """SELECT perm, sum(r * x1 * x1) AS g11, sum(r * x1 * x2) AS g12, sum(r * x2 * x2) AS g22 FROM permx GROUP BY 1""",
    "perma": """SELECT a.perm, sum(a.x1 * b.x1 * v) AS s11, sum(a.x1 * b.x2 * v) AS s12, sum(a.x2 * b.x2 * v) AS s22
        FROM permx a JOIN permx b USING (perm) JOIN kern ON i = a.site AND k = b.site GROUP BY 1""",
    "perm2": """SELECT *, (g22 * s11 - 2 * g12 * s12 + g11 * s22) / (g11 * g22 - g12 * g12) AS fit,
        (s11 * s22 - s12 * s12) / (g11 * g22 - g12 * g12) AS det, (SELECT count(*) FROM rw) AS n
        FROM permg JOIN perma USING (perm) CROSS JOIN inert""",
    "permo": """SELECT m12 AS a1, l1 - m11 AS a2 FROM eig""",
    "permf": """SELECT perm, 'model' AS term, s11 / g11 / ((total - s11 / g11) / (n - 2)) AS f FROM perm2
        UNION ALL SELECT perm, 's_bal', (fit - s22 / g22) / ((total - fit) / (n - 3)) FROM perm2
        UNION ALL SELECT perm, 'o_price', (fit - s11 / g11) / ((total - fit) / (n - 3)) FROM perm2
        UNION ALL SELECT perm, 'CCA1', (fit + sqrt(greatest(fit * fit - 4 * det, 0))) / 2 / ((total - fit) / (n - 3)) FROM perm2
        UNION ALL SELECT perm, 'CCA2', (b1 * b1 * s11 + 2 * b1 * b2 * s12 + b2 * b2 * s22)
        / (b1 * b1 * g11 + 2 * b1 * b2 * g12 + b2 * b2 * g22) / ((total - fit) / (n - 3)) FROM (
        SELECT *, -(g12 * a1 + g22 * a2) AS b1, g11 * a1 + g12 * a2 AS b2 FROM perm2 CROSS JOIN permo)""",
}


def sql(body: str) -> str:
    """Prefix a query with the shared tables it names, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    once = {"ez", "em", "ey", "em2", "hp", "hkern", "hpx", "hpm", "hpf"}  # read several times, some in every step of a recursion
    parts = ", ".join(f"{name} AS {'MATERIALIZED ' if name in once else ''}({CTES[name]})" for name in CTES if name in needed)
    return f"WITH RECURSIVE {parts} {body}" if parts else body


def inverted(source: str, places: list[int], carried: str) -> str:
    """Rows of ``source`` with v{i}_{j}, the inverse of the symmetric g{i}_{j} over some places, by the sweep operator."""

    def at(a: str, i: int, j: int) -> str:
        return f"{a}{min(i, j)}_{max(i, j)}"

    cells = [(i, j) for n, i in enumerate(places) for j in places[n:]]
    text = f"SELECT {carried}, {', '.join(f'{at('g', *c)} AS {at('a', *c)}' for c in cells)} FROM {source}"
    for k in places:
        d = at("a", k, k)
        moved = {
            (i, j): f"-1 / {d}" if i == j == k else f"{at('a', i, j)} / {d}" if k in (i, j)
            else f"{at('a', i, j)} - {at('a', i, k)} * {at('a', k, j)} / {d}"
            for i, j in cells
        }
        text = f"SELECT {carried}, {', '.join(f'{e} AS {at('a', *c)}' for c, e in moved.items())} FROM ({text})"
    return f"SELECT {carried}, {', '.join(f'-{at('a', *c)} AS {at('v', *c)}' for c in cells)} FROM ({text})"


def trace(places: list[int]) -> str:
    """Sum of v * s over a symmetric pair of matrices: the inertia explained by the covariates at those places."""
    return " + ".join(f"{1 if i == j else 2} * v{i}_{j} * s{i}_{j}" for n, i in enumerate(places) for j in places[n:])


def margin(k: int, places: list[int]) -> str:
    """What covariate k adds to the others."""

    def v(i: int) -> str:
        return f"v{min(i, k)}_{max(i, k)}"

    terms = [f"{1 if i == j else 2} * {v(i)} * s{i}_{j} * {v(j)}" for n, i in enumerate(places) for j in places[n:]]
    return f"({' + '.join(terms)}) / {v(k)}"


ALL = ["c_bal", "n_cust", "n_rich", "s_bal", "n_supp", "o_price"]
SIX = list(range(1, 7))
_CELLS = [(i, j) for i in SIX for j in range(i, 7)]
CTES |= {
    "hel": "SELECT entity, site, sqrt(abundance / sum(abundance) OVER (PARTITION BY site)) AS abundance FROM cut",
    "hp": "SELECT site, entity, abundance / (SELECT sum(abundance) FROM hel) AS p FROM hel",
    "hr": "SELECT site, sum(p) AS r FROM hp GROUP BY 1",
    "hc": "SELECT entity, sum(p) AS c FROM hp GROUP BY 1",
    "hinert": "SELECT sum(p * p / (r * c)) - 1 AS total FROM hp JOIN hr USING (site) JOIN hc USING (entity)",
    "hx": "SELECT site, r, " + ", ".join(f"{c} - sum(r * {c}) OVER () AS x{i}" for i, c in zip(SIX, ALL)) + " FROM hr JOIN covf USING (site)",
    "hg": "SELECT 0 AS perm, " + ", ".join(f"sum(r * x{i} * x{j}) AS g{i}_{j}" for i, j in _CELLS) + " FROM hx",
    "hkern": """SELECT a.site AS i, b.site AS k, sum(a.p * b.p / c) AS v FROM hp a JOIN hp b USING (entity) JOIN hc USING (entity)
        GROUP BY 1, 2""",
    "hs": "SELECT "
    + ", ".join(f"sum(a.x{i} * b.x{j} * v) AS s{i}_{j}" for i, j in _CELLS)
    + " FROM hkern JOIN hx a ON a.site = i JOIN hx b ON b.site = k",
    "hv": inverted("hg", SIX, "perm"),
    "horder": """SELECT perm, site, row_number() OVER (PARTITION BY perm ORDER BY
        CASE WHEN perm = 0 THEN lpad(CAST(site AS VARCHAR), 9, '0') ELSE md5('7|' || perm || '|' || site) END) AS pos
        FROM hr CROSS JOIN (SELECT unnest(range(0, 1000)) AS perm)""",
    "hplaced": """SELECT perm, s.site, r, t.* EXCLUDE (site) FROM horder o JOIN (SELECT site, r, row_number() OVER (ORDER BY site) AS pos FROM hr) s
        USING (pos) JOIN covf t ON t.site = o.site""",
    "hpx": "SELECT perm, site, r, " + ", ".join(f"{c} - sum(r * {c}) OVER (PARTITION BY perm) AS x{i}" for i, c in zip(SIX, ALL)) + " FROM hplaced",
    "hpg": "SELECT perm, " + ", ".join(f"sum(r * x{i} * x{j}) AS g{i}_{j}" for i, j in _CELLS) + " FROM hpx GROUP BY 1",
    "hps": "SELECT a.perm, "
    + ", ".join(f"sum(a.x{i} * b.x{j} * v) AS s{i}_{j}" for i, j in _CELLS)
    + " FROM hpx a JOIN hpx b USING (perm) JOIN hkern ON i = a.site AND k = b.site GROUP BY 1",
    "hpv": inverted("hpg", SIX, "perm"),
    "hpm": f"SELECT *, {trace(SIX)} AS fit, (SELECT count(*) FROM hr) AS n FROM hpv JOIN hps USING (perm) CROSS JOIN hinert",
    "hpf": "SELECT perm, 'model' AS term, fit / 6 / ((total - fit) / (n - 7)) AS f FROM hpm "
    + " ".join(f"UNION ALL SELECT perm, '{c}', {margin(i, SIX)} / ((total - fit) / (n - 7)) FROM hpm" for i, c in zip(SIX, ALL)),
}


def r6(value: str, name: str) -> str:
    return f"round({value}, 6) + 0.0 AS {name}"


def _site_columns(value: str = "abundance") -> str:
    return ", ".join(f"coalesce(sum({value}) FILTER (site = {s}), 0) AS site_{s}" for s in range(25))


_LEVELS = ["MACHINERY", "HOUSEHOLD", "FURNITURE", "BUILDING", "AUTOMOBILE"]
_ORD = "CASE level " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(_LEVELS, 1)) + " END"
_TOTAL_CLASS = """SELECT label AS class, coalesce(sum(total), 0) AS total FROM dim
    LEFT JOIN (SELECT entity, sum(abundance) AS total FROM {cells} GROUP BY 1) t USING (entity)
    WHERE entity IN ({members}) GROUP BY 1"""


def _ratio(above: str, below: str) -> str:
    return f"CASE WHEN {below} = 0 AND {above} <> 0 THEN 0 WHEN {below} = 0 THEN NULL ELSE {above} / ({below}) END"


_BODIES: dict[str, str] = {
    "annotation_union": """SELECT entity, gene_id, marker FROM ann UNION ALL SELECT entity, NULL, marker FROM annp""",
    "union_by_name": """SELECT c_nationkey AS site, c_acctbal AS customer, CAST(NULL AS DOUBLE) AS supplier FROM customer
        UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier""",
    "tagged_union": """SELECT pathway, entity, phylum, class FROM fixers JOIN dim USING (entity)
        UNION ALL SELECT 'NONE', entity, phylum, class FROM dim WHERE entity NOT IN (SELECT entity FROM fixers)""",
    "site_report": "SELECT code, region, type, site FROM sites",
    "drop_sites": "SELECT * FROM ab WHERE site NOT IN (SELECT site FROM sites WHERE region = 'AFRICA')",
    "rename_sites": """SELECT entity, CASE WHEN type = 'F' THEN code ELSE CAST(site AS VARCHAR) END AS site, abundance
        FROM ab JOIN sites USING (site)""",
    "site_key": """SELECT c_custkey, 'SURVEY_' || region || '..' || replace(code, '_', '-') || '_' || c_custkey AS label,
        replace(code, '_', '-') AS site FROM customer JOIN sites ON c_nationkey = site""",
    "split_key": "SELECT c_custkey, c_mktsegment AS segment, c_name AS name FROM customer",
    "taxon_name": """SELECT entity, replace(trim(replace(concat_ws(', ', name, kingdom, phylum, class, ord_rank, family, genus,
        species), ',', ' ')), '  ', ', ') AS taxon_name FROM dim""",
    "strip_first_rank": """SELECT entity, regexp_replace(replace(trim(replace(concat_ws(', ', name, kingdom, phylum, class,
        ord_rank, family, genus, species), ',', ' ')), '  ', ', '), '^[^,]+,\\s*', '') AS taxon_name FROM dim""",
    "class_label": "SELECT entity, label AS class FROM dim",
    "case_label": """SELECT CASE marker WHEN '1RF' THEN 'CBB' WHEN '2AF' THEN 'Wood-Ljungdahl' WHEN '3NO' THEN 'Wood-Ljungdahl'
        WHEN '6RF' THEN 'rTCA' ELSE 'other' END AS pathway, count(*) AS n FROM annp GROUP BY 1""",
    "trophic_candidates": "SELECT entity, candidate FROM cand WHERE candidate IS NOT NULL",
    "trophic_class": """SELECT entity, candidate, cbb_p AS cbb, rtca_p AS rtca, wl_p AS wl,
        greatest(cbb_p, rtca_p, wl_p) AS "Autotrophy", 1 - greatest(cbb_p, rtca_p, wl_p) AS "Heterotrophy" FROM fl""",
    "marker_filter": "SELECT * FROM ann WHERE marker = 'Brand#1'",
    "marker_any": """SELECT DISTINCT entity FROM ann WHERE marker IN ('Brand#1', 'Brand#2')
        AND entity IN (SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000)""",
    "marker_all": """SELECT entity FROM ann WHERE marker IN ('Brand#1', 'Brand#2') GROUP BY 1
        HAVING count(DISTINCT marker) = 2""",
    "marker_chain": """SELECT entity FROM ann GROUP BY 1 HAVING bool_or(marker IN ('Brand#1', 'Brand#2'))
        AND bool_or(marker IN ('Brand#3', 'Brand#4'))""",
    "marker_pivot": "SELECT entity, "
    + ", ".join(f"CAST(max(CASE WHEN marker = 'Brand#{i}' THEN 1 ELSE 0 END) AS INTEGER) AS brand_{i}" for i in (1, 2, 3))
    + " FROM ann WHERE marker IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1",
    "marker_catalogue": """SELECT a.entity, m.metabolism, a.gene_id, m.gene, a.marker FROM annp a JOIN (
        SELECT DISTINCT l_returnflag AS metabolism, 'gene' || l_linestatus AS gene,
        l_linenumber || l_returnflag || l_linestatus AS marker FROM lineitem) m ON a.marker = m.marker
        WHERE a.entity IN (SELECT entity FROM cand WHERE candidate = 'autotroph')""",
    "redox_traits": "SELECT entity, trait, value FROM redox",
    "apply_overrides": """SELECT entity, trait, CASE WHEN trait = 'Aerobic' AND p_retailprice >= 1000 THEN 0
        WHEN trait = 'Sulfur Oxidation*' AND p_size <= 2 THEN 1 ELSE value END AS value
        FROM redox JOIN part ON entity = p_partkey""",
    "taxon_mask": """SELECT entity, trait, CASE WHEN trait = 'Aerobic' AND (phylum = 'Brand#3' OR ord_rank = 'red') THEN 0
        WHEN trait = 'Microaerobic' AND class = 'PROMO' THEN 0 ELSE value END AS value FROM redox JOIN dim USING (entity)""",
    "conditional_mask": """SELECT entity, trait, kind, CASE WHEN trait = 'Microaerobic' AND wl_p = 1 THEN 0 ELSE value END
        AS value FROM traits JOIN fl USING (entity)""",
    "flag_by_keys": """SELECT entity, phylum, CAST(entity IN (SELECT entity FROM annp WHERE marker = '1RF') AS INTEGER) AS flag
        FROM dim""",
    "abundance_cutoff": "SELECT entity, site, CASE WHEN abundance < 20 THEN 0 ELSE abundance END AS abundance FROM ab",
    "binarize": "SELECT entity, site, CAST(abundance >= 20 AS INTEGER) AS present FROM ab",
    "fixed_order": """SELECT p_partkey, p_type, CASE p_type WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LARGE' THEN 3
        WHEN 'STANDARD' THEN 4 WHEN 'PROMO' THEN 5 END AS ord FROM part""",
    "enrich_abundance": """SELECT entity, phylum, class, code, region, abundance FROM ab JOIN dim USING (entity)
        JOIN sites USING (site)""",
    "natural_join": "SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)",
    "left_enrich": "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "semi_members": "SELECT entity, phylum FROM dim WHERE entity IN (SELECT entity FROM comm WHERE community = 'prevalent')",
    "anti_members": """SELECT entity, phylum FROM dim
        WHERE entity NOT IN (SELECT entity FROM comm WHERE community = 'prevalent')""",
    "donor_acceptor_pairs": """SELECT d.entity, d.trait AS donor, d.value AS donor_value, a.trait AS acceptor,
        a.value AS acceptor_value FROM redox d JOIN redox a ON d.entity = a.entity AND d.kind = 'donor' AND a.kind = 'acceptor'""",
    "align_sites": f"""SELECT site, abundance, {r6("s_bal", "s_bal")} FROM (SELECT site, sum(abundance) AS abundance FROM cut
        GROUP BY 1) JOIN cov USING (site) WHERE s_bal IS NOT NULL""",
    "phylum_site_sum": "SELECT phylum, site, sum(abundance) AS abundance FROM ab JOIN dim USING (entity) GROUP BY 1, 2",
    "entity_total": "SELECT entity, sum(abundance) AS total FROM ab GROUP BY 1",
    "entity_mean": f"SELECT entity, {r6('sum(abundance) / (SELECT count(*) FROM nation)', 'mean')} FROM cut GROUP BY 1",
    "standard_error": f"""SELECT entity, {r6("stddev_samp(coalesce(abundance, 0)) / sqrt(count(*))", "standard_error")} FROM (
        SELECT DISTINCT entity FROM cut) CROSS JOIN (SELECT n_nationkey AS site FROM nation) LEFT JOIN cut USING (entity, site)
        GROUP BY 1""",
    "value_counts": """SELECT value, count(*) AS n FROM (SELECT l_returnflag AS value FROM lineitem
        UNION ALL SELECT l_linestatus FROM lineitem UNION ALL SELECT CAST(l_linenumber AS VARCHAR) FROM lineitem) GROUP BY 1""",
    "distinct_taxa": """SELECT phylum, count(DISTINCT class) AS classes, count(DISTINCT ord_rank) AS orders
        FROM dim GROUP BY 1""",
    "phylum_percent": f"""SELECT phylum, sum(abundance) AS total,
        {r6("sum(abundance) / sum(sum(abundance)) OVER () * 100", "percent")} FROM ab JOIN dim USING (entity)
        JOIN comm USING (entity) WHERE community = 'prevalent' GROUP BY 1""",
    "rescale_minmax": f"""SELECT p_partkey, {r6('''coalesce((p_retailprice - min(p_retailprice) OVER b)
        / nullif(max(p_retailprice) OVER b - min(p_retailprice) OVER b, 0) * 19 + 1, 10.5)''', "within")},
        {r6('''coalesce((p_retailprice - min(p_retailprice) OVER ()) / nullif(max(p_retailprice) OVER ()
        - min(p_retailprice) OVER (), 0), 0.5)''', "overall")} FROM part WINDOW b AS (PARTITION BY p_brand)""",
    "average_rank": """SELECT entity, site, abundance, CAST(rank() OVER (PARTITION BY site ORDER BY abundance) AS DOUBLE)
        + (count(*) OVER (PARTITION BY site, abundance) - 1) / CAST(2 AS DOUBLE) AS avg_rank FROM ab""",
    "category_order": """SELECT class, total, dense_rank() OVER (ORDER BY total) AS ord FROM (
        SELECT label AS class, sum(abundance) AS total FROM ab JOIN dim USING (entity) GROUP BY 1)""",
    "label_order": """SELECT class, dense_rank() OVER (ORDER BY class) AS ord FROM (SELECT label AS class FROM dim
        UNION SELECT 'unknown phylum, unknown class')""",
    "make_unique": """SELECT p_partkey, p_name || CASE WHEN n > 0 THEN '.' || n ELSE '' END AS unique_label FROM (
        SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part)""",
    "top_k_other": "SELECT class, total, ord, CASE WHEN ord <= 10 THEN class ELSE 'Other' END AS label FROM ("
    "SELECT class, total, row_number() OVER (ORDER BY total DESC, class) AS ord FROM ("
    + _TOTAL_CLASS.format(cells="ab", members="SELECT entity FROM comm WHERE community = 'prevalent'")
    + "))",
    "class_stack_order": f"SELECT class, {r6('total / 25', 'mean')}, row_number() OVER (ORDER BY total DESC, class) AS ord FROM ("
    + _TOTAL_CLASS.format(cells="cut", members="SELECT entity FROM fixers")
    + ")",
    "unpivot_sites": """SELECT entity, CAST(site AS VARCHAR) AS site, coalesce(abundance, 0) AS abundance FROM (
        SELECT DISTINCT entity FROM ab) CROSS JOIN (SELECT n_nationkey AS site FROM nation) LEFT JOIN ab USING (entity, site)""",
    "transpose_matrix": "SELECT CAST(n_nationkey AS VARCHAR) AS site, "
    + ", ".join(f"coalesce(sum(l_quantity) FILTER (l_returnflag = '{f}'), 0) AS flag_{f.lower()}" for f in "ANR")
    + """ FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""",
    "heatmap_cells": f"""SELECT entity, site, {r6("ln(coalesce(abundance, 0) + 0.5)", "log_abundance")} FROM (
        SELECT DISTINCT entity FROM cut) CROSS JOIN (SELECT n_nationkey AS site FROM nation) LEFT JOIN cut USING (entity, site)""",
    "clean_abundance": """SELECT entity, site, CASE WHEN abundance < 20 THEN 0 ELSE abundance END AS abundance, phylum, class,
        completeness, contamination FROM ab JOIN dim USING (entity)
        WHERE site NOT IN (SELECT site FROM sites WHERE region = 'AFRICA')""",
    "abundance_floor": "SELECT min(peak) AS cut_off FROM (SELECT max(abundance) AS peak FROM ab GROUP BY entity)",
    "region_abundance": """SELECT entity, site, abundance, region FROM cut JOIN sites USING (site)
        WHERE region IN ('ASIA', 'EUROPE')""",
    "metabolism_site_abundance": """SELECT metabolism, region, site, coalesce(abundance, 0) AS abundance,
        coalesce(number, 0) AS number FROM (SELECT DISTINCT metabolism FROM members) CROSS JOIN sites LEFT JOIN (
        SELECT metabolism, site, sum(abundance) AS abundance, count(*) AS number FROM members JOIN cut USING (entity)
        GROUP BY 1, 2) USING (metabolism, site)""",
    "metabolism_class_abundance": f"""SELECT metabolism, p.region, label AS class,
        {r6("sum(total) / any_value(n_sites)", "average_abundance")}, count(*) AS number FROM members
        JOIN (SELECT entity, region, sum(abundance) AS total FROM cut JOIN sites USING (site) GROUP BY 1, 2) p USING (entity)
        JOIN dim USING (entity) JOIN (SELECT region, count(*) AS n_sites FROM sites GROUP BY 1) s ON s.region = p.region
        GROUP BY 1, 2, 3""",
    "fixation_redox": f"""SELECT entity, pathway, label AS class, trait, {r6("m", "mean_abundance")},
        CAST(m > 0 AS INTEGER) AS occurrence FROM (SELECT r.entity, pathway, label, trait,
        CASE WHEN value > 0 THEN coalesce(mean, 0) ELSE 0 END AS m FROM redox r JOIN fixers f ON r.entity = f.entity
        JOIN dim d ON d.entity = r.entity JOIN comm c ON c.entity = r.entity AND community = 'prevalent'
        LEFT JOIN (SELECT entity, sum(abundance) / (SELECT count(*) FROM sites WHERE region = 'ASIA') AS mean FROM cut
        JOIN sites USING (site) WHERE region = 'ASIA' GROUP BY 1) t ON t.entity = r.entity)""",
    "community_redox_se": f"""SELECT depth, entity, class, trait, {r6("m", "mean_abundance")},
        {r6("coalesce(se, 0)", "standard_error")}, CAST(m > 0 AS INTEGER) AS occurrence FROM (
        SELECT CASE WHEN community = 'prevalent' THEN 'shallow' ELSE 'deep' END AS depth, r.entity, label AS class, trait, se,
        CASE WHEN value > 0 THEN coalesce(mean, 0) ELSE 0 END AS m FROM redox r JOIN dim d ON d.entity = r.entity
        JOIN comm c ON c.entity = r.entity LEFT JOIN (SELECT entity, avg(coalesce(abundance, 0)) AS mean,
        stddev_samp(coalesce(abundance, 0)) / sqrt(count(*)) AS se FROM (SELECT DISTINCT entity FROM cut)
        CROSS JOIN (SELECT n_nationkey AS site FROM nation) LEFT JOIN cut USING (entity, site) GROUP BY 1) t
        ON t.entity = r.entity WHERE r.entity IN (SELECT entity FROM fixers))""",
    "fixation_trait_totals": """SELECT r.trait AS metabolism, f.trait AS pathway, CAST(sum(r.value * f.value) AS BIGINT) AS number
        FROM redox r JOIN fix f ON r.entity = f.entity GROUP BY 1, 2""",
    "trait_prevalence": f"""SELECT community, trait, count(*) FILTER (value > 0) AS n_with_trait,
        {r6("count(*) FILTER (value > 0) / count(*) * 100", "percent_entities")},
        {r6("coalesce(sum(total) FILTER (value > 0), 0) / sum(total) * 100", "percent_abundance")}
        FROM traits JOIN comm USING (entity) LEFT JOIN (SELECT entity, sum(abundance) AS total FROM cut GROUP BY 1) t
        USING (entity) GROUP BY 1, 2""",
    "trait_members": "SELECT community, trait, entity FROM traits JOIN comm USING (entity) WHERE value > 0",
    "pathway_site_matrix": f"""SELECT community, pathway, {_site_columns()} FROM fixers JOIN comm USING (entity)
        JOIN cut USING (entity) GROUP BY 1, 2""",
    "presence_agreement": f"""SELECT CAST(difference AS INTEGER) AS difference, count(*) AS n,
        {r6("count(*) / sum(count(*)) OVER () * 100", "percent")} FROM (
        SELECT f.entity, s.site, CAST(g.entity IS NOT NULL AS INTEGER) - CAST(c.entity IS NOT NULL AS INTEGER) AS difference
        FROM (SELECT DISTINCT entity FROM fixers) f CROSS JOIN sites s LEFT JOIN (SELECT DISTINCT a.entity, s_nationkey AS site
        FROM annp a JOIN lineitem ON a.gene_id = l_orderkey JOIN supplier ON l_suppkey = s_suppkey
        WHERE marker IN ('1RF', '2AF', '3NO')) g ON g.entity = f.entity AND g.site = s.site
        LEFT JOIN cut c ON c.entity = f.entity AND c.site = s.site) GROUP BY 1""",
    "presence_excluded": f"""SELECT CAST(difference AS INTEGER) AS difference, count(*) AS n,
        {r6("count(*) / sum(count(*)) OVER () * 100", "percent")} FROM (
        SELECT f.entity, s.site, CAST(g.entity IS NOT NULL AS INTEGER) - CAST(c.entity IS NOT NULL AS INTEGER) AS difference
        FROM (SELECT DISTINCT entity FROM fixers) f CROSS JOIN sites s LEFT JOIN (SELECT DISTINCT a.entity, s_nationkey AS site
        FROM annp a JOIN lineitem ON a.gene_id = l_orderkey JOIN supplier ON l_suppkey = s_suppkey
        WHERE marker IN ('1RF', '2AF', '3NO') AND a.gene_id NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000)) g
        ON g.entity = f.entity AND g.site = s.site
        LEFT JOIN cut c ON c.entity = f.entity AND c.site = s.site) GROUP BY 1""",
    "csv_round_trip": """SELECT c_custkey, c_name AS name,
        CASE WHEN left(md5(CAST(c_custkey AS VARCHAR)), 1) <> '0' THEN c_acctbal END AS balance FROM customer""",
    "numeric_parse": """SELECT c_custkey,
        CASE WHEN left(md5(CAST(c_custkey AS VARCHAR)), 1) <> '0' THEN c_acctbal END AS balance FROM customer""",
    "column_range": "SELECT p_partkey, p_brand, p_type, p_size FROM part",
    "strict_wl": "SELECT entity FROM sc WHERE wl > 0.6",
    "percent_text": """SELECT c_nationkey AS site, CAST(CAST(round(avg(CAST(c_mktsegment = 'BUILDING' AS INTEGER)) * 100) AS BIGINT)
        AS VARCHAR) || '%' AS share FROM customer GROUP BY 1""",
    "quality_tier": """SELECT entity, regexp_replace(replace(trim(replace(concat_ws(', ', name, kingdom, phylum, class,
        ord_rank, family, genus, species), ',', ' ')), '  ', ', '), '^[^,]+,\\s*', '') AS name,
        trna_total, ra, rn, rr, size, completeness, contamination,
        CAST(trna_total >= 16 AND ra = 1 AND rn = 1 AND rr = 1 AS INTEGER) AS high_quality FROM (
        SELECT l_partkey AS entity, CAST(count(DISTINCT l_orderkey % 20) AS INTEGER) AS trna_total,
        CAST(bool_or(l_returnflag = 'A') AS INTEGER) AS ra, CAST(bool_or(l_returnflag = 'N') AS INTEGER) AS rn,
        CAST(bool_or(l_returnflag = 'R') AS INTEGER) AS rr FROM lineitem GROUP BY 1)
        JOIN dim USING (entity)""",
    "cumulative_cultured": f"""SELECT level, membership, n, {_ORD} AS ord,
        {r6("n / sum(n) OVER (PARTITION BY membership)", "share")},
        {r6(f"sum(n) OVER (PARTITION BY membership ORDER BY {_ORD}) / sum(n) OVER (PARTITION BY membership)", "cumulative_share")}
        FROM (SELECT c_mktsegment AS level, region AS membership, count(*) AS n FROM customer
        JOIN sites ON c_nationkey = site GROUP BY 1, 2 UNION ALL SELECT c_mktsegment, 'All', count(*) FROM customer GROUP BY 1)""",
    "ratio_features": "SELECT site, "
    + ", ".join(
        r6(_ratio(a, b), k)
        for k, a, b in [
            ("price_cust", "o_price", "n_cust"),
            ("rich_cust", "n_rich", "n_cust"),
            ("bal_rich", "c_bal", "n_rich"),
            ("rich_rich", "n_rich", "n_rich"),
            ("bals_price", "(c_bal + s_bal)", "o_price"),
            ("cust_units", "n_cust", "(n_supp + n_rich)"),
        ]
    )
    + " FROM cov",
}

_COV = ["c_bal", "n_cust", "n_rich", "s_bal", "n_supp", "o_price"]
_VIF = """CROSS JOIN (SELECT g12 / sqrt(g11 * g22) AS r12, g13 / sqrt(g11 * g33) AS r13, g23 / sqrt(g22 * g33) AS r23 FROM gg)"""
_DET = "(1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23)"
_HOLED = """SELECT c_custkey, CASE WHEN md5(CAST(c_custkey AS VARCHAR))[1] <> '0' THEN c_acctbal END AS c_acctbal,
    CASE WHEN md5(CAST(c_custkey AS VARCHAR))[1] <> '1' THEN c_mktsegment END AS c_mktsegment, price, n FROM customer
    LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS price, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1)
    ON o_custkey = c_custkey"""

_BODIES |= {
    "spearman_sites": f"SELECT site_a, site_b, {r6('rho', 'rho')} FROM srho WHERE site_a < site_b",
    "profile_distance": f"SELECT a AS site_a, b AS site_b, {r6('d', 'distance')} FROM sdist",
    "spearman_entities": f"""SELECT entity_a, entity_b, {r6("rho", "rho")} FROM (SELECT x.entity AS entity_a, y.entity AS entity_b,
        corr(x.r, y.r) AS rho FROM erank x JOIN erank y ON x.site = y.site AND x.entity < y.entity GROUP BY 1, 2)
        WHERE abs(round(rho, 9)) >= 0.7""",
    "hellinger": f"SELECT entity, site, {r6('sqrt(abundance / sum(abundance) OVER (PARTITION BY site))', 'abundance')} FROM cut",
    "zscore": " UNION ALL ".join(
        f"SELECT site, '{c}' AS covariate, {r6(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()', 'z')} FROM cov" for c in _COV
    ),
    "covariate_corr": " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, CAST(regr_count({a}, {b}) AS BIGINT) AS n, {r6(f'corr({a}, {b})', 'r')} FROM cov"
        for i, a in enumerate(_COV)
        for b in _COV[i + 1 :]
    ),
    "impute_baseline": f"""WITH h AS ({_HOLED}) SELECT c_custkey, coalesce(c_mktsegment, (SELECT c_mktsegment FROM h
        WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS c_mktsegment,
        {r6("coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM h))", "c_acctbal")},
        {r6("coalesce(price, (SELECT avg(price) FROM h))", "price")}, {r6("coalesce(n, (SELECT avg(n) FROM h))", "n")} FROM h""",
    "cca_one": f"""SELECT {r6("total", "total")}, {r6("s / g11", "constrained")}, {r6("s / g11 / total", "explained")}
        FROM inert CROSS JOIN gg CROSS JOIN (SELECT sum(h1 * h1) AS s FROM hh)""",
    "cca_eigen": f"""SELECT axis, {r6("v", "eigenvalue")}, {r6("v / tr", "share")}, {r6("v / total", "share_of_total")},
        {r6("CASE axis WHEN 'CCA1' THEN v / tr ELSE 1 END", "cumulative")} FROM (
        SELECT axis, tr, (tr + d * sqrt(tr * tr - 4 * det)) / 2 AS v FROM (
        SELECT (g22 * s11 - 2 * g12 * s12 + g11 * s22) / (g11 * g22 - g12 * g12) AS tr,
        (s11 * s22 - s12 * s12) / (g11 * g22 - g12 * g12) AS det FROM gg
        CROSS JOIN (SELECT sum(h1 * h1) AS s11, sum(h1 * h2) AS s12, sum(h2 * h2) AS s22 FROM hh))
        CROSS JOIN (VALUES ('CCA1', 1), ('CCA2', -1)) t(axis, d)) CROSS JOIN inert""",
    "vif_two": f"""SELECT covariate, {r6("1 / (1 - g12 * g12 / (g11 * g22))", "vif")} FROM gg
        CROSS JOIN (VALUES ('s_bal'), ('o_price')) t(covariate)""",
    "vif": f"""SELECT covariate, {r6(f"(1 - CASE covariate WHEN 's_bal' THEN r23 * r23 WHEN 'o_price' THEN r13 * r13 ELSE r12 * r12 END) / {_DET}", "vif")}
        FROM (VALUES ('s_bal'), ('o_price'), ('n_cust')) t(covariate) {_VIF}""",
    "clade_label": """SELECT 'R' || r_regionkey AS node, lower(r_name) AS clade FROM region
        UNION ALL SELECT 'N' || n_nationkey, lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 'C' || c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' ELSE lower(r_name) END
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 'O' || o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' ELSE lower(r_name) END
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "tip_labels": """SELECT node, short || CASE WHEN n > 0 THEN '.' || n ELSE '' END AS tip_label, length FROM (
        SELECT p_partkey AS node, p_name AS short, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n,
        CASE WHEN p_size = 1 THEN 1e-16 ELSE p_size / CAST(10 AS DOUBLE) END AS length FROM part)""",
}



def _tested(terms: str) -> str:
    return f"""SELECT o.term, {r6("o.f", "f")}, count(p.f) AS reached, {r6("(1 + count(p.f)) / CAST(10000 AS DOUBLE)", "p")}
        FROM (SELECT term, f FROM permf WHERE perm = 0) o LEFT JOIN permf p
        ON p.term = o.term AND p.perm > 0 AND p.f >= o.f - 1e-9 WHERE o.term IN ({terms}) GROUP BY o.term, o.f"""


_BODIES |= {
    "permutation_f": _tested("'model'"),
    "permutation_margin": _tested("'s_bal', 'o_price'"),
    "permutation_axis": _tested("'CCA1', 'CCA2'"),
}


_BODIES |= {
    "cca_model": f"""SELECT {r6("total", "total")}, {r6("fit", "constrained")}, {r6("fit / total", "explained")} FROM (
        SELECT {trace(SIX)} AS fit FROM hv CROSS JOIN hs) CROSS JOIN hinert""",
    "vif_model": " UNION ALL ".join(f"SELECT '{c}' AS covariate, {r6(f'g{i}_{i} * v{i}_{i}', 'vif')} FROM hg JOIN hv USING (perm)" for i, c in zip(SIX, ALL))
    + " UNION ALL SELECT unnest(['twice', 'flat', 'mixed']), NULL",
    "constraint_aliases": """SELECT * FROM (VALUES ('twice', 'aliased', 's_bal', CAST(2 AS DOUBLE)), ('flat', 'constant', NULL, NULL),
        ('mixed', 'aliased', 'o_price', CAST(1 AS DOUBLE)), ('mixed', 'aliased', 'n_cust', CAST(-100 AS DOUBLE))) t(covariate, reason, source, coefficient)""",
    "permutation_model": f"""SELECT o.term, {r6("o.f", "f")}, count(p.f) AS reached, {r6("(1 + count(p.f)) / CAST(1000 AS DOUBLE)", "p")}
        FROM (SELECT term, f FROM hpf WHERE perm = 0) o LEFT JOIN hpf p
        ON p.term = o.term AND p.perm > 0 AND p.f >= o.f - 1e-9 GROUP BY o.term, o.f""",
}


_PLACES = "(SELECT site, region FROM sites UNION ALL SELECT site, 'all' FROM sites)"
_SIZES = f"(SELECT region, count(*) AS n_sites FROM {_PLACES} GROUP BY 1)"
_GROUPED = f"""(SELECT pathway, community, region, class, total, total / n_sites AS mean,
    row_number() OVER (PARTITION BY pathway, community, region ORDER BY total DESC, class) AS ord FROM (
    SELECT pathway, community, region, label AS class, sum(abundance) AS total FROM fixers JOIN comm USING (entity)
    JOIN dim USING (entity) JOIN cut USING (entity) JOIN {_PLACES} USING (site) WHERE abundance <> 0 GROUP BY 1, 2, 3, 4)
    JOIN {_SIZES} USING (region))"""
_BODIES |= {
    "top_k_groups": f"""SELECT pathway, community, region, label, total, {r6("mean", "mean")}, CAST(ord AS INTEGER) AS ord FROM (
        SELECT pathway, community, region, CASE WHEN ord <= 10 THEN class ELSE 'Other' END AS label, sum(total) AS total,
        sum(mean) AS mean, min(ord) AS ord FROM {_GROUPED} GROUP BY 1, 2, 3, 4)""",
    "stack_order_groups": f"""SELECT pathway, community, region, class, {r6("mean", "mean")}, ord FROM {_GROUPED}""",
    "phylum_percent_groups": f"""SELECT community, phylum, sum(abundance) AS total,
        {r6("sum(abundance) / sum(sum(abundance)) OVER (PARTITION BY community) * 100", "percent")} FROM ab JOIN dim USING (entity)
        JOIN comm USING (entity) GROUP BY 1, 2""",
    "fixation_redox_groups": f"""SELECT region, community, entity, pathway, class, trait, {r6("m", "mean_abundance")},
        CAST(m > 0 AS INTEGER) AS occurrence FROM (SELECT s.region, community, r.entity, pathway, label AS class, trait,
        CASE WHEN value > 0 THEN coalesce(total, 0) / n_sites ELSE 0 END AS m FROM redox r JOIN fixers USING (entity)
        JOIN dim USING (entity) JOIN comm USING (entity) CROSS JOIN {_SIZES} s LEFT JOIN (SELECT entity, region, sum(abundance) AS total
        FROM cut JOIN {_PLACES} USING (site) GROUP BY 1, 2) t ON t.entity = r.entity AND t.region = s.region)""",
    "class_abundance_all": f"""SELECT metabolism, region, label AS class, {r6("sum(total) / any_value(n_sites)", "average_abundance")},
        count(*) AS number FROM members JOIN (SELECT entity, region, sum(abundance) AS total FROM cut JOIN {_PLACES} USING (site)
        GROUP BY 1, 2) USING (entity) JOIN dim USING (entity) JOIN {_SIZES} USING (region) GROUP BY 1, 2, 3""",
}


def _scores(part: str, key: str, table: str, value: str) -> str:
    one, two = (f"max({value}) FILTER (axis = {k})" for k in (1, 2))
    return f"""SELECT '{part}' AS part, CAST({key} AS BIGINT) AS key, {r6(one, '"CCA1"')}, {r6(two, '"CCA2"')}
        FROM {table} GROUP BY {key}"""


_BODIES |= {
    "cca_scores": " UNION ALL ".join(
        [
            _scores("sites/entity", "entity", "esc", "v"),
            _scores("sites/site", "site", "ssc", "u"),
            _scores("species/entity", "entity", "esc", "v * sqrt(l)"),
            _scores("species/site", "site", "ssc", "u / sqrt(l)"),
        ]
    ),
    "decorate_scores": f"""SELECT e.*, label AS class, {r6("""1 + 19 * (mean - min(mean) OVER ())
        / (max(mean) OVER () - min(mean) OVER ())""", "size")}, NULL AS abbrev, NULL AS region
        FROM ({_scores("entity", "entity", "esc", "v * sqrt(l)")}) e JOIN dim ON dim.entity = key
        JOIN (SELECT entity, sum(abundance) / 25 AS mean FROM cut GROUP BY 1) m ON m.entity = key
        UNION ALL SELECT s.*, NULL, NULL, code || type, region FROM ({_scores("site", "site", "ssc", "u / sqrt(l)")}) s
        JOIN sites ON sites.site = key""",
}

_BODIES |= {
    "linkage_sites": f"""SELECT m.a AS "left", m.b AS "right", {r6("d", "height")},
        CAST(len(string_split(items, ',')) AS BIGINT) AS size FROM mg m JOIN lo ON lo.step = m.step AND lo.c = m.a""",
    "leaf_order": """SELECT CAST(id AS INTEGER) AS id, CAST(row_number() OVER (ORDER BY i) - 1 AS BIGINT) AS position FROM (
        SELECT unnest(string_split(items, ',')) AS id, generate_subscripts(string_split(items, ','), 1) AS i
        FROM lo WHERE step = (SELECT max(step) FROM lo))""",
    "cut_sites": """SELECT CAST(id AS INTEGER) AS id, CAST(dense_rank() OVER (ORDER BY c) AS INTEGER) AS cluster FROM (
        SELECT c, unnest(string_split(items, ',')) AS id FROM lo WHERE step = (SELECT count(*) FROM mg WHERE d <= 1.5))""",
}

_BODIES |= {
    "linkage_merges": f"""SELECT a AS "left", b AS "right", {r6("d", "height")}, CAST(n AS BIGINT) AS size FROM em2""",
    "cut_tree": "SELECT entity AS id, cluster FROM eroot",
    "community_split": """SELECT entity, label AS class, cluster, CASE WHEN cluster IN (1, 5) THEN 'regional' ELSE 'prevalent' END AS community
        FROM eroot JOIN dim USING (entity)""",
}

ORACLES: dict[str, str] = {name: sql(body) for name, body in _BODIES.items()}
