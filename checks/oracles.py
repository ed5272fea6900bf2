"""ANSI SQL for the registered queries, independent of the engine's plans.

Each statement is the list of common table expressions it needs, in a fixed
order, followed by its own SELECT.
"""

from __future__ import annotations

FOCAL = "(" + ", ".join(f"'Brand#{i}'" for i in range(1, 9)) + ")"


def _stage1() -> dict[str, str]:
    c = "o_custkey"
    return {
        "occ": f"""
SELECT CAST(l_orderkey AS VARCHAR) || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|'
   || CAST(l_quantity AS BIGINT) || '|' || CAST(round(l_extendedprice*100) AS BIGINT) || '|'
   || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS row_key,
 CASE WHEN p_size = 50 THEN NULL ELSE 'urn:lsid:dyntaxa.se:Taxon:' || CAST(1000 + p_size*2 + p_partkey%2 AS VARCHAR) END AS taxonID,
 p_brand AS scientificName, p_name AS vernacularName,
 CASE WHEN l_linenumber=7 AND l_suppkey%10=0 THEN NULL ELSE CAST(55.5 AS DOUBLE) + CAST(({c}*7919)%12007 AS DOUBLE)/1000 END AS decimalLatitude,
 CAST(11 AS DOUBLE) + CAST(({c}*104729)%13007 AS DOUBLE)/1000 AS decimalLongitude,
 CASE l_linenumber WHEN 1 THEN substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR),1,4) WHEN 2 THEN substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR),1,7)
   WHEN 3 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || 'T00:00:00' END AS eventDate,
 CAST(500000 + (l_orderkey*7919 + l_linenumber*104729)%9973 AS DOUBLE) AS E,
 CAST(6580000 + (l_partkey*6101 + l_orderkey*31)%9967 AS DOUBLE) AS N,
 l_returnflag AS part
FROM lineitem JOIN part ON l_partkey=p_partkey JOIN orders ON l_orderkey=o_orderkey""",
        "base": """
SELECT *, CASE length(tok) WHEN 4 THEN tok || '-01-01' WHEN 7 THEN tok || '-01' ELSE tok END AS date_s FROM (
 SELECT *, TRY_CAST(NULLIF(regexp_extract(taxonID,'([0-9]+)$',1),'') AS BIGINT) AS taxon_id,
 round(decimalLatitude,3) AS lat_r, round(decimalLongitude,3) AS lon_r,
 'cell_' || CAST(round(decimalLatitude,3) AS VARCHAR) || '_' || CAST(round(decimalLongitude,3) AS VARCHAR) AS LocalityID,
 NULLIF(regexp_extract(eventDate,'([0-9]{4}(-[0-9]{2}){0,2})',1),'') AS tok FROM occ) q""",
        "loc": """
SELECT LocalityID, median(lat_r) AS lat_r, median(lon_r) AS lon_r, COUNT(*) AS n_records, COUNT(DISTINCT date_s) AS n_events,
 COUNT(DISTINCT taxon_id)+MAX(CASE WHEN taxon_id IS NULL THEN 1 ELSE 0 END) AS n_species,
 MIN(date_s) AS first_event, MAX(date_s) AS last_event FROM base GROUP BY LocalityID""",
        "eff": """
SELECT *, 0.5e0*n_events + 0.5e0*CASE WHEN n_events>0 THEN CAST(n_species AS DOUBLE)/n_events ELSE 0e0 END AS effort_index FROM loc""",
        "ranked": """
SELECT *, row_number() OVER (ORDER BY effort_index, LocalityID NULLS LAST) AS rn, COUNT(*) OVER () AS n_all,
 (SELECT median(effort_index) FROM eff) AS med FROM eff""",
        "weighted": """
SELECT *, CAST(least(floor((10*rn-1)/n_all),9) AS BIGINT) AS effort_stratum,
 least(greatest(CASE WHEN effort_index>0 THEN med/effort_index ELSE 1e0 END, 0.2e0),5e0) AS w_inv FROM ranked""",
        "taxa": "SELECT DISTINCT CAST(1000 + p_size*2 + p_partkey%2 AS BIGINT) AS taxon_id FROM part WHERE p_size <> 50",
        "ias": "SELECT taxon_id FROM taxa WHERE taxon_id % 11 = 0",
        "n2k": """
SELECT taxon_id, 0.25e0 AS weight FROM taxa WHERE taxon_id % 5 = 0
UNION ALL SELECT taxon_id, 0.25e0 + (taxon_id % 10)/20e0 FROM taxa WHERE taxon_id % 5 = 0""",
        "labels": "SELECT taxon_id, 'hab' || CAST(taxon_id % 6 AS VARCHAR) AS habitat FROM taxa WHERE taxon_id % 13 <> 0",
        "pairs": "SELECT DISTINCT LocalityID, taxon_id FROM base",
        "ias_n": """
SELECT LocalityID, COUNT(DISTINCT p.taxon_id) AS n_ias FROM pairs p JOIN ias USING (taxon_id) WHERE LocalityID IS NOT NULL GROUP BY LocalityID""",
        "n2k_n": """
SELECT LocalityID, COUNT(*) AS n_n2k, SUM(w) AS score FROM (SELECT LocalityID, p.taxon_id, MAX(weight) AS w FROM pairs p JOIN n2k USING (taxon_id)
 WHERE LocalityID IS NOT NULL GROUP BY 1, 2) q GROUP BY LocalityID""",
        "dom": """
SELECT LocalityID, coalesce(habitat,'Unknown') AS habitat, purity FROM (
 SELECT LocalityID, habitat, CAST(n AS DOUBLE)/SUM(n) OVER (PARTITION BY LocalityID) AS purity,
  row_number() OVER (PARTITION BY LocalityID ORDER BY n DESC, habitat ASC NULLS LAST) AS r FROM (
  SELECT LocalityID, habitat, COUNT(*) AS n FROM pairs LEFT JOIN labels USING (taxon_id) GROUP BY 1,2) g) x WHERE r=1""",
        "master": """
SELECT w.LocalityID, CAST(NULL AS VARCHAR) AS SWEREF_N, CAST(NULL AS VARCHAR) AS SWEREF_E, lat_r, lon_r, CAST(NULL AS VARCHAR) AS county_id,
 first_event, last_event, n_records, n_events, n_species,
 coalesce(n_ias,0) AS n_species_IAS, greatest(n_species - coalesce(n_ias,0), 0) AS n_species_nonIAS,
 CAST(coalesce(n_ias,0) AS DOUBLE)/n_species AS IAS_share_species,
 coalesce(n_n2k,0) AS n_species_N2K, coalesce(score,0e0) AS n2000_score, effort_index, w_inv, effort_stratum,
 CASE WHEN n_records>1 THEN (n_species-1)/ln(n_records) END AS Margalef_local,
 CASE WHEN n_records>1 THEN (greatest(n_species - coalesce(n_ias,0), 0)-1)/ln(n_records) END AS Margalef_exIAS,
 coalesce(d.habitat,'Unknown') AS dominant_habitat, coalesce(d.purity,0e0) AS dominant_habitat_purity
FROM weighted w LEFT JOIN ias_n i ON w.LocalityID=i.LocalityID LEFT JOIN n2k_n k ON w.LocalityID=k.LocalityID LEFT JOIN dom d ON w.LocalityID=d.LocalityID""",
    }


INSIDE = """(o.E-s.E)*(o.E-s.E)+(o.N-s.N)*(o.N-s.N) <= 2500
 AND sqrt((o.E-s.E)*(o.E-s.E)+(o.N-s.N)*(o.N-s.N)) * cos(ang(o.N-s.N, o.E-s.E)) <= 50*cos(pi()/64) + 1e-9""".replace(
    "ang(o.N-s.N, o.E-s.E)",
    "(CASE WHEN atan2(o.N-s.N,o.E-s.E)<0 THEN atan2(o.N-s.N,o.E-s.E)+2*pi() ELSE atan2(o.N-s.N,o.E-s.E) END"
    " - floor((CASE WHEN atan2(o.N-s.N,o.E-s.E)<0 THEN atan2(o.N-s.N,o.E-s.E)+2*pi() ELSE atan2(o.N-s.N,o.E-s.E) END)/(pi()/32))*(pi()/32) - pi()/64)",
)


def _stage2(runs: int = 1) -> dict[str, str]:
    return {
        "focal_pts": f"SELECT scientificName AS focal, * FROM base WHERE scientificName IN {FOCAL}",
        "sites": f"""
SELECT run, focal, CAST(rn-1 AS BIGINT) AS fid, LocalityID AS LocalityKey, E, N FROM (
 SELECT *, row_number() OVER (PARTITION BY run, focal ORDER BY md5('42|' || run || '|' || row_key || '|' || E || '|' || N), row_key, E, N) AS rn
 FROM focal_pts CROSS JOIN (SELECT CAST(unnest(range(1,{runs + 1})) AS INTEGER) AS run) r) q WHERE rn<=350""",
        "hits": f"""
SELECT s.run, s.focal, s.fid, o.taxon_id, o.LocalityID, coalesce(o.taxon_id%7=0, false) AS is_red, o.E, o.N
FROM (SELECT *, CAST(floor(E/50) AS BIGINT) AS cx, CAST(floor(N/50) AS BIGINT) AS cy FROM base WHERE scientificName NOT IN {FOCAL}) o
JOIN (SELECT *, CAST(floor(E/50) AS BIGINT)+dx AS cx, CAST(floor(N/50) AS BIGINT)+dy AS cy
 FROM sites CROSS JOIN (VALUES (-1),(0),(1)) a(dx) CROSS JOIN (VALUES (-1),(0),(1)) b(dy)) s
ON o.cx=s.cx AND o.cy=s.cy AND {INSIDE}""",
        "kept": """
SELECT run, focal, taxon_id, is_red, COUNT(*) AS n_hits FROM hits WHERE taxon_id IS NOT NULL GROUP BY 1,2,3,4 HAVING COUNT(*)>=15""",
        "found": """
SELECT run, focal, (SELECT COUNT(*) FROM focal_pts f WHERE f.focal=s.focal) AS focal_obs,
 coalesce((SELECT string_agg(CAST(taxon_id AS VARCHAR),' ' ORDER BY CAST(taxon_id AS VARCHAR)) FROM kept k WHERE k.run=s.run AND k.focal=s.focal),'') AS ids,
 coalesce((SELECT string_agg(CAST(taxon_id AS VARCHAR),' ' ORDER BY CAST(taxon_id AS VARCHAR)) FROM kept k WHERE k.run=s.run AND k.focal=s.focal AND is_red),'') AS red_ids,
 (SELECT COUNT(*) FROM kept k WHERE k.run=s.run AND k.focal=s.focal) AS n_assoc,
 (SELECT COUNT(*) FROM kept k WHERE k.run=s.run AND k.focal=s.focal AND is_red) AS n_red
FROM (SELECT DISTINCT run, focal FROM sites) s""",
        "red_loc": """
SELECT run, focal, LocalityID, COUNT(DISTINCT taxon_id) AS n_red FROM hits WHERE is_red AND LocalityID IS NOT NULL GROUP BY 1,2,3""",
    }


_FOLDER = "replace({f},'#','_') || CASE WHEN {r}>1 THEN '__' || lpad(CAST({r}-1 AS VARCHAR),3,'0') ELSE '' END"


def _folder(f: str, r: str) -> str:
    return _FOLDER.format(f=f, r=r)


def _over(value: str) -> str:
    return ", ".join(
        f"SUM(CASE WHEN {value}>{t} THEN w_inv ELSE 0e0 END) AS c{t}" for t in range(5)
    )


_SUMS = ["n", "nw", *[f"c{t}" for t in range(5)]]


def _metrics(f: str, b: str, tau: str) -> str:
    ll = " + ".join(
        f"ln((({f}.c{t}+0.5e0)/({f}.nw+1e0))/(({b}.c{t}+0.5e0)/({b}.nw+1e0)))/ln(2e0)"
        for t in range(5)
    )
    hit = [f"({f}.c{t}/{f}.nw >= {tau})" for t in range(5)]
    up = [f"({f}.c{t}/{f}.nw - {b}.c{t}/{b}.nw)" for t in range(5)]
    n = " + ".join(f"CAST({h} AS INTEGER)" for h in hit)
    lift = " + ".join(f"CASE WHEN {h} THEN greatest(0e0,{u}) ELSE 0e0 END" for h, u in zip(hit, up))
    enr = " + ".join(f"CASE WHEN {h} AND {u}>1e-12 THEN 1e0 ELSE 0e0 END" for h, u in zip(hit, up))
    return (
        f"({ll})/5e0 AS mean_loglift, CASE WHEN {n}>0 THEN {lift} END AS lifted, "
        f"CASE WHEN {n}>0 THEN ({enr})/({n}) END AS frac"
    )


def _stage3() -> dict[str, str]:
    sums = ", ".join(f"SUM({c}) AS {c}" for c in _SUMS)
    return {
        "lm": "SELECT * FROM master WHERE LocalityID IS NOT NULL",
        "fl": f"""
SELECT {_folder('r.focal', 'r.run')} AS folder, r.focal, r.LocalityID, CAST(n_red AS DOUBLE) AS value, w_inv, effort_stratum, dominant_habitat, n2000_score
FROM red_loc r JOIN lm USING (LocalityID)""",
        "fh": f"""
SELECT {_folder('focal', 'run')} AS folder, focal, run, 'hab' || (CAST(substr(focal,7) AS BIGINT)%6) AS main_hab
FROM (SELECT DISTINCT run, focal FROM sites) q""",
        "f_tot": f"SELECT folder, COUNT(*) AS n, SUM(w_inv) AS nw, {_over('value')} FROM fl GROUP BY folder",
        "b_tot": f"""
SELECT h.folder, COUNT(o.folder) AS n, coalesce(SUM(w_inv),0e0) AS nw, {_over('value')}
FROM fh h LEFT JOIN fl o ON o.dominant_habitat=h.main_hab AND o.folder<>h.folder GROUP BY h.folder""",
        "a1": f"""
SELECT h.folder, h.main_hab, f.n AS n_focal, b.n AS n_background, mean_loglift, lifted, frac,
 CASE WHEN f.n<30 THEN 'TOO_FEW_FOCAL_LOCALITIES (' || f.n || ' < 30)' WHEN b.n=0 THEN 'NO_BACKGROUND_LOCALITIES_SAME_HABITAT'
 ELSE 'OK (F=' || f.n || ', BG=' || b.n || ')' END AS A1_debug
FROM fh h JOIN f_tot f ON h.folder=f.folder JOIN b_tot b ON h.folder=b.folder
LEFT JOIN (SELECT f.folder, {_metrics('f', 'b', '0.3e0')} FROM f_tot f JOIN b_tot b ON f.folder=b.folder WHERE f.n>=30 AND b.n>0) m ON m.folder=h.folder""",
        "pool": """
SELECT h.folder, h.main_hab, l.LocalityID, l.n2000_score, l.w_inv,
 CASE WHEN EXISTS (SELECT 1 FROM lm x WHERE x.dominant_habitat=h.main_hab) THEN 'h:' || h.main_hab ELSE '*' END AS pool,
 EXISTS (SELECT 1 FROM fl WHERE fl.folder=h.folder AND fl.LocalityID=l.LocalityID) AS own
FROM fh h JOIN lm l ON l.dominant_habitat=h.main_hab OR NOT EXISTS (SELECT 1 FROM lm x WHERE x.dominant_habitat=h.main_hab)""",
        "a5_sets": f"""
SELECT folder, pool, own, COUNT(*) AS n, SUM(w_inv) AS nw, {_over('n2000_score')} FROM pool GROUP BY folder, pool, own""",
        "a5": f"""
SELECT p.folder, p.pool, coalesce(f.n,0) AS n_in_pool, coalesce(b.n,0) AS n_rest, mean_loglift,
 CASE WHEN t.n<30 THEN 'TOO_FEW_FOCAL_LOCALITIES (' || t.n || ' < 30)' WHEN f.n IS NULL THEN 'NO_FOCAL_LOCALITIES_IN_LM (n_ids=' || t.n || ')'
 WHEN b.n IS NULL THEN 'NO_BACKGROUND_LOCALITIES_IN_LM' ELSE 'OK (F=' || f.n || ', BG=' || b.n || ')' END AS A5_debug
FROM (SELECT DISTINCT folder, pool FROM pool) p JOIN f_tot t ON t.folder=p.folder
LEFT JOIN a5_sets f ON f.folder=p.folder AND f.own LEFT JOIN a5_sets b ON b.folder=p.folder AND NOT b.own
LEFT JOIN (SELECT f.folder, {_metrics('f', 'b', '0.25e0')} FROM a5_sets f JOIN a5_sets b ON f.folder=b.folder AND f.own AND NOT b.own
 JOIN f_tot t ON t.folder=f.folder WHERE t.n>=30) m ON m.folder=p.folder""",
        "purity": f"""
SELECT h.folder, AVG(CASE WHEN l.habitat=h.main_hab THEN 1e0 ELSE 0e0 END) AS Habitat_purity
FROM (SELECT DISTINCT {_folder('focal', 'run')} AS folder, taxon_id FROM kept) k JOIN fh h USING (folder) JOIN labels l USING (taxon_id) GROUP BY h.folder""",
    }


def _spot(total: str, *parts: str) -> str:
    """Position below ``total`` from the first 52 bits of a digest."""
    text = " || '|' || ".join(parts)
    share = f"CAST(('0x' || substr(md5({text}),1,13)) AS BIGINT)/4503599627370496e0"
    return f"least(CAST(floor({share}*CAST({total} AS DOUBLE)) AS BIGINT), {total}-1)"


def _intervals(stage: str, tau: str) -> dict[str, str]:
    """Bootstrap from ``u`` (folder, n_focal, n_background), ``fo`` and ``pr`` (focal and background rows)."""
    tag = f"'42|{stage}"
    sums = ", ".join(
        ["CAST(SUM(wf) AS BIGINT) AS nw"]
        + [f"CAST(SUM(CASE WHEN lvl>{t} THEN wf ELSE 0 END) AS BIGINT) AS c{t}" for t in range(5)]
    )
    units = ", ".join(f"CAST(SUM({c}) AS DOUBLE)/1e9 AS {c}" for c in _SUMS if c != "n")

    def from_start(group: str, order: str) -> str:
        return (
            f"CAST(SUM(wf) OVER (PARTITION BY {group} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT)-wf AS lo, "
            f"CAST(SUM(wf) OVER (PARTITION BY {group}) AS BIGINT) AS total"
        )

    return {
        "fr": f"SELECT *, {from_start('folder', 'key, lvl, wf, stratum')}, row_number() OVER (PARTITION BY folder ORDER BY key, lvl, wf, stratum) AS idx FROM fo",
        "fd": f"SELECT folder, rep, {_spot('total', tag + '|focal' + chr(39), 'folder', 'rep', 'idx')} AS spot FROM fr CROSS JOIN (SELECT unnest(range(50)) AS rep) q",
        "ft": f"""
SELECT d.folder, d.rep, r.stratum, COUNT(*) AS k, {sums} FROM fd d ASOF JOIN (SELECT folder, lo, wf, lvl, stratum FROM fr WHERE wf>0) r
 ON d.folder=r.folder AND d.spot>=r.lo GROUP BY 1,2,3""",
        "al": """
SELECT f.*, available, least(n_background, 1000) AS draw_size, CASE WHEN available>0 THEN CAST(round_even(CAST(k AS DOUBLE)/
 CAST(SUM(k) OVER (PARTITION BY f.folder, rep) AS DOUBLE)*least(n_background, 1000),0) AS BIGINT) ELSE 0 END AS alloc
FROM ft f JOIN u ON u.folder=f.folder LEFT JOIN (SELECT folder, stratum, COUNT(*) AS available FROM pr GROUP BY 1,2) a
 ON a.folder=f.folder AND a.stratum=f.stratum""",
        "br": "SELECT *, row_number() OVER (PARTITION BY folder, stratum ORDER BY owner, key, lvl, wf) AS r FROM pr",
        "pk": f"""
SELECT folder, rep, stratum, j, {_spot('available', tag + '|pick' + chr(39), 'folder', 'rep', 'stratum', 'j')}+1 AS r
FROM (SELECT *, unnest(range(1, alloc+1)) AS j FROM al WHERE alloc>0) q""",
        "dr": f"SELECT folder, rep, stratum, j, wf, lvl, {from_start('folder, rep', 'stratum, j')} FROM pk JOIN br USING (folder, stratum, r)",
        "rd": f"SELECT folder, rep, {_spot('total', tag + '|redraw' + chr(39), 'folder', 'rep', 'stratum', 'j')} AS spot FROM dr",
        "bt": f"""
SELECT d.folder, d.rep, {sums} FROM rd d ASOF JOIN (SELECT folder, rep, lo, wf, lvl FROM dr WHERE wf>0) r
 ON d.folder=r.folder AND d.rep=r.rep AND d.spot>=r.lo GROUP BY 1,2""",
        "lost": "SELECT folder, rep, MAX(draw_size) AS draw_size FROM al GROUP BY 1,2 HAVING MAX(alloc)=0",
        "gr": f"SELECT folder, wf, lvl, {from_start('folder', 'stratum, owner, key, lvl, wf')} FROM pr",
        "gd": f"""
SELECT folder, rep, {_spot('total', tag + '|global' + chr(39), 'folder', 'rep', 'j')} AS spot
FROM (SELECT *, unnest(range(1, draw_size+1)) AS j FROM lost JOIN (SELECT DISTINCT folder, total FROM gr) t USING (folder)) q""",
        "gt": f"""
SELECT d.folder, d.rep, {sums} FROM gd d ASOF JOIN (SELECT folder, lo, wf, lvl FROM gr WHERE wf>0) r
 ON d.folder=r.folder AND d.spot>=r.lo GROUP BY 1,2""",
        "fs": f"SELECT folder, rep, {units} FROM ft GROUP BY 1,2",
        "bs": f"SELECT folder, rep, {units} FROM (SELECT * FROM bt UNION ALL SELECT * FROM gt) q GROUP BY 1,2",
        "boot": f"SELECT f.folder, {_metrics('f', 'b', tau)} FROM fs f JOIN bs b ON b.folder=f.folder AND b.rep=f.rep",
    }


def _ends(*names: str) -> str:
    return ", ".join(
        f"round(quantile_cont({column},{at}),6) AS {name}_CI_{end}"
        for column, name in (n.split(":") for n in names)
        for end, at in (("low", "0.025"), ("high", "0.975"))
    )


_LEVEL = "+".join(f"CAST({{v}}>{t} AS INTEGER)" for t in range(5))


def _boot_row(value: str) -> str:
    return (
        f"LocalityID AS key, {_LEVEL.format(v=value)} AS lvl, CAST(effort_stratum AS BIGINT) AS stratum, "
        "CAST(floor(greatest(w_inv,0e0)*1000000000e0+0.5e0) AS BIGINT) AS wf"
    )


def _a1_intervals() -> dict[str, str]:
    row = _boot_row("value")
    return {
        "u": "SELECT folder, main_hab AS pool, n_focal, n_background FROM a1 WHERE A1_debug LIKE 'OK%'",
        "fo": f"SELECT folder, {row} FROM fl WHERE folder IN (SELECT folder FROM u)",
        "pr": f"SELECT u.folder, o.folder AS owner, {row} FROM u JOIN fl o ON o.dominant_habitat=u.pool AND o.folder<>u.folder",
        **_intervals("a1", "0.3e0"),
    }


def _a5_intervals() -> dict[str, str]:
    row = _boot_row("n2000_score")
    return {
        "u": "SELECT folder, n_in_pool AS n_focal, n_rest AS n_background FROM a5 WHERE A5_debug LIKE 'OK%'",
        "sides": f"SELECT p.folder, p.own, {row} FROM (SELECT folder, own, LocalityID FROM pool WHERE folder IN (SELECT folder FROM u)) p JOIN lm USING (LocalityID)",
        "fo": "SELECT folder, key, lvl, stratum, wf FROM sides WHERE own",
        "pr": "SELECT folder, CAST(NULL AS VARCHAR) AS owner, key, lvl, stratum, wf FROM sides WHERE NOT own",
        **_intervals("a5", "0.25e0"),
    }


def _robust(table: str, metric: str, z: str) -> str:
    """z-scores of one metric: per habitat, or global under five values."""
    return f"""
SELECT r.folder, CASE WHEN h.n<5 THEN
  CASE WHEN g.mad>0 THEN 0.6745e0*(x-g.m)/g.mad WHEN g.sd>0 THEN (x-g.m)/g.sd ELSE 0e0 END
 ELSE CASE WHEN h.mad>0 THEN 0.6745e0*(x-h.m)/h.mad WHEN h.sd>0 THEN (x-h.m)/h.sd ELSE 0e0 END END AS {z}
FROM (SELECT folder, main_hab, {metric} AS x FROM {table}) r
JOIN (SELECT main_hab, median(x) AS m, stddev_samp(x) AS sd, COUNT(x) AS n, median(abs(x-mm)) AS mad
 FROM (SELECT main_hab, {metric} AS x, median({metric}) OVER (PARTITION BY main_hab) AS mm FROM {table}) q GROUP BY main_hab) h ON h.main_hab=r.main_hab
CROSS JOIN (SELECT median(x) AS m, stddev_samp(x) AS sd, median(abs(x-mm)) AS mad
 FROM (SELECT {metric} AS x, median({metric}) OVER () AS mm FROM {table}) q) g"""


_METRICS = {
    "mean_loglift": "Z_exceed",
    "n2k_mean_loglift": "Z_N2000",
    "Habitat_purity": "Z_HAB_purity",
}


def _scored(table: str) -> dict[str, str]:
    out = {f"z_{i}": _robust(table, m, z) for i, (m, z) in enumerate(_METRICS.items())}
    out["scored"] = f"""
SELECT r.*, Z_exceed, Z_N2000, Z_HAB_purity, (Z_exceed*0.4e0 + Z_N2000*0.4e0 + Z_HAB_purity*0.2e0) AS composite_index
FROM {table} r JOIN z_0 USING (folder) JOIN z_1 USING (folder) JOIN z_2 USING (folder)"""
    return out


def _breaks(table: str, value: str) -> dict[str, str]:
    """Best split of the non-negative values into four runs, by trying all."""
    sse = "(b.q-a.q) - (b.s-a.s)*(b.s-a.s)/(b.i-a.i)"
    return {
        "vals": f"SELECT {value} AS x, row_number() OVER (ORDER BY {value}) AS i FROM {table} WHERE {value} >= 0",
        "pre": """
SELECT i, (SELECT SUM(x) FROM vals v WHERE v.i<=p.i) AS s, (SELECT SUM(x*x) FROM vals v WHERE v.i<=p.i) AS q FROM vals p
UNION ALL SELECT 0, 0e0, 0e0""",
        "seg": f"SELECT a.i AS a, b.i AS b, {sse} AS c FROM pre a JOIN pre b ON a.i<b.i",
        "best": """
SELECT s1.b AS c1, s2.b AS c2, s3.b AS c3 FROM seg s1 JOIN seg s2 ON s2.a=s1.b JOIN seg s3 ON s3.a=s2.b JOIN seg s4 ON s4.a=s3.b
WHERE s1.a=0 AND s4.b=(SELECT MAX(i) FROM vals) ORDER BY s1.c+s2.c+s3.c+s4.c, c3, c2, c1 LIMIT 1""",
        "cuts": """
SELECT DISTINCT x FROM (SELECT x FROM vals WHERE i IN (SELECT c1+1 FROM best UNION ALL SELECT c2+1 FROM best UNION ALL SELECT c3+1 FROM best)
 UNION ALL SELECT MAX(x) FROM vals) u WHERE x > (SELECT MIN(x) FROM vals) AND EXISTS (SELECT 1 FROM best)""",
    }


def _class(value: str) -> str:
    """First distinct limit not below the value; no class without two limits."""
    return (
        f"CASE WHEN {value}>=0 AND (SELECT COUNT(*) FROM cuts)>0 THEN CAST(least("
        f"1+(SELECT COUNT(*) FROM cuts c WHERE c.x<{value}), (SELECT COUNT(*) FROM cuts)) AS DOUBLE) END"
    )


METRIC_ROWS = {
    "metric_rows": """
SELECT p_brand || '__' || l_linenumber AS folder, p_brand AS brand,
 CASE WHEN b=3 THEN 'rare' || l_linenumber ELSE 'hab' || (b%5) END AS main_hab,
 CASE WHEN l_linenumber<>7 THEN round(d,6) END AS mean_loglift, round(t,6) AS n2k_mean_loglift,
 CASE WHEN b%5<>2 THEN 0.25e0 END AS Habitat_purity, round(q,6) AS q
FROM (SELECT p_brand, l_linenumber, CAST(substr(p_brand,7) AS BIGINT) AS b, AVG(l_discount) AS d, AVG(l_tax) AS t, AVG(l_quantity) AS q
 FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2,3) g"""
}

RUNS = {
    "runs": """
SELECT CASE WHEN l_suppkey%17<>0 THEN 'sp' || l_suppkey END AS focal_id,
 CASE WHEN l_linenumber=6 THEN NULL ELSE round(AVG(l_discount)*40-1.9e0,6) END AS value,
 CASE WHEN l_linenumber%2=0 THEN CAST(COUNT(*)%5 AS DOUBLE) END AS value_class, COUNT(*)*20 AS No_obs
FROM lineitem GROUP BY l_suppkey, l_linenumber, l_returnflag"""
}


def _stability(source: str) -> dict[str, str]:
    return {
        "usable": f"SELECT focal_id, value, value_class FROM runs WHERE value IS NOT NULL AND {source}",
        "agg": """
SELECT focal_id, COUNT(*) AS n_runs, AVG(value) AS mean, coalesce(stddev_samp(value),0e0) AS sd, MIN(value) AS min, MAX(value) AS max,
 AVG(CASE WHEN value>0 THEN 1e0 ELSE 0e0 END) AS pos, AVG(CASE WHEN value>=1 THEN 1e0 ELSE 0e0 END) AS ge1,
 AVG(CASE WHEN value<0 THEN 1e0 ELSE 0e0 END) AS neg, AVG(CASE WHEN value=0 THEN 1e0 ELSE 0e0 END) AS zero,
 AVG(CASE WHEN value_class IS NULL THEN NULL WHEN value_class>=3 THEN 1e0 ELSE 0e0 END) AS cls FROM usable GROUP BY focal_id""",
        "stab": """
SELECT *, max-min AS range, sd/greatest(abs(mean),1e-12) AS relative_sd,
 CASE WHEN mean>0 THEN pos WHEN mean<0 THEN neg ELSE zero END AS same FROM agg""",
    }


_STAB_COLS = """focal_id, n_runs, round(mean,10) AS mean, round(sd,10) AS sd, round(min,10) AS min, round(max,10) AS max,
 round(range,10) AS range, round(relative_sd,10) AS relative_sd, round(pos,10) AS stability_pos, round(ge1,10) AS stability_ge1,
 round(same,10) AS stability_same_sign, round(cls,10) AS stability_class3plus"""
_SCORE = "(0.5e0*pos+0.3e0*same+0.2e0*ge1)"


def _sql(ctes: dict[str, str], select: str) -> str:
    head = ",\n".join(f"{name} AS ({body})" for name, body in ctes.items())
    return f"WITH {head}\n{select}"


def _r6(*names: str) -> str:
    return ", ".join(f"round({n},6) AS {n}" for n in names)


def _tallies(prefix: str, alias: str) -> str:
    return ", ".join(
        f"round(coalesce({alias}.{c},0e0),6) AS {prefix}_{c}" for c in _SUMS if c != "n"
    )


_PROJECT = """
SELECT lat, lon, round(6.36490216611273959e+06*(xi+8.37731824734434371e-04*sin(2*xi)*cosh(2*eta)+7.60852778882616384e-07*sin(4*xi)*cosh(4*eta)+1.19763801917315365e-09*sin(6*xi)*cosh(6*eta)+2.44337624251036816e-12*sin(8*xi)*cosh(8*eta)),3) AS north,
 round(6.36490216611273959e+06*(eta+8.37731824734434371e-04*cos(2*xi)*sinh(2*eta)+7.60852778882616384e-07*cos(4*xi)*sinh(4*eta)+1.19763801917315365e-09*cos(6*xi)*sinh(6*eta)+2.44337624251036816e-12*cos(8*xi)*sinh(8*eta))+5e5,3) AS east FROM (
 SELECT lat, lon, atan2(tan(ps),cos(dl)) AS xi, atanh(cos(ps)*sin(dl)) AS eta FROM (
  SELECT lat, lon, p-sin(p)*cos(p)*(6.69438002290078694e-03+3.72956021104529824e-05*power(sin(p),2)+2.59252751897402525e-07*power(sin(p),4)+1.97169894728422150e-09*power(sin(p),6)) AS ps, dl FROM (
   SELECT DISTINCT round(decimalLatitude,3) AS lat, round(decimalLongitude,3) AS lon, radians(decimalLatitude) AS p, radians(decimalLongitude-15e0) AS dl
   FROM occ WHERE decimalLatitude IS NOT NULL AND decimalLongitude IS NOT NULL) a) b) c"""


def _degrees() -> dict[str, str]:
    """Stage 2 from degrees: selectors by id or name, region, padded cells; every focal record is a site."""
    lat, lon = "59e0 + CAST((o_custkey*7919)%401 AS DOUBLE)*0.0003e0", "17e0 + CAST((o_custkey*104729)%409 AS DOUBLE)*0.0007e0"
    taxon = "1000 + p_size*2 + p_partkey%2"
    metres = _PROJECT.replace("SELECT DISTINCT round(decimalLatitude,3) AS lat, round(decimalLongitude,3) AS lon", "SELECT DISTINCT decimalLatitude AS lat, decimalLongitude AS lon")
    return {
        "occ": f"""
SELECT p_brand AS name, CASE WHEN p_size<>50 THEN {taxon} END AS taxon, CASE WHEN o_custkey%3=0 THEN 'Lake ' || (o_custkey%50) END AS locality,
 CASE WHEN l_linenumber=6 AND l_suppkey%10=1 THEN 50e0 WHEN l_linenumber=5 THEN {lat} + 3 ELSE {lat} END AS decimalLatitude,
 CASE WHEN l_linenumber=4 THEN {lon} + CAST(l_suppkey%200 AS DOUBLE)*0.0007e0 ELSE {lon} END AS decimalLongitude
FROM lineitem JOIN part ON l_partkey=p_partkey JOIN orders ON l_orderkey=o_orderkey""",
        "metres": metres,
        "rec": """
SELECT o.*, m.north AS N, m.east AS E, (coalesce(taxon%29=0, false) OR name IN ('Brand#1', 'Brand#2')) AS is_focal,
 coalesce(locality, 'cell_' || printf('%.3f', decimalLatitude) || '_' || printf('%.3f', decimalLongitude)) AS loc
FROM occ o JOIN metres m ON m.lat=decimalLatitude AND m.lon=decimalLongitude WHERE decimalLatitude BETWEEN 55 AND 69.5 AND decimalLongitude BETWEEN 10 AND 25""",
        "box": "SELECT 614000e0 + n_nationkey%5*1000 AS x0, 6541000e0 + (n_nationkey//5)*1500 AS y0 FROM nation",
        "foc": """
SELECT r.* FROM rec r WHERE is_focal AND EXISTS (SELECT 1 FROM box WHERE r.E BETWEEN x0 AND x0+800 AND r.N BETWEEN y0 AND y0+1200)""",
        "s": "SELECT name AS focal, E, N, COUNT(*) AS k, CAST(floor(E/50) AS BIGINT) AS cx, CAST(floor(N/50) AS BIGINT) AS cy FROM foc GROUP BY name, E, N",
        "o": """
SELECT taxon, loc, E, N, COUNT(*) AS k, CAST(floor(E/50) AS BIGINT) AS cx, CAST(floor(N/50) AS BIGINT) AS cy FROM rec WHERE NOT is_focal GROUP BY taxon, loc, E, N""",
        "near": f"""
SELECT s.focal, o.taxon, o.loc, s.k*o.k AS n FROM o JOIN (SELECT focal, E, N, k, cx+dx AS cx, cy+dy AS cy FROM s
 CROSS JOIN (VALUES (-1),(0),(1)) a(dx) CROSS JOIN (VALUES (-1),(0),(1)) b(dy)) s ON o.cx=s.cx AND o.cy=s.cy AND {INSIDE}""",
        "keep": "SELECT focal, taxon FROM near WHERE taxon IS NOT NULL GROUP BY 1,2 HAVING SUM(n)>=15",
    }


def _inverse(n: str, e: str, source: str, keep: str) -> dict[str, str]:
    """Metres to degrees with the series coefficients written out from f."""
    return {
        "par": "SELECT (1/298.257222101e0)/(2-1/298.257222101e0) AS n, (1/298.257222101e0)*(2-1/298.257222101e0) AS e2",
        "coef": """
SELECT 0.9996e0*6378137e0/(1+n)*(1+n*n/4+n*n*n*n/64) AS rad,
 n/2-2*n*n/3+37*n*n*n/96-n*n*n*n/360 AS d1, n*n/48+n*n*n/15-437*n*n*n*n/1440 AS d2, 17*n*n*n/480-37*n*n*n*n/840 AS d3, 4397*n*n*n*n/161280 AS d4,
 e2+e2*e2+e2*e2*e2+e2*e2*e2*e2 AS ca, -(7*e2*e2+17*e2*e2*e2+30*e2*e2*e2*e2)/6 AS cb, (224*e2*e2*e2+889*e2*e2*e2*e2)/120 AS cc, -4279*e2*e2*e2*e2/1260 AS cd
FROM par""",
        "inv0": f"SELECT {keep}, {n}/rad AS xi, ({e}-500000e0)/rad AS eta, c.* FROM {source} CROSS JOIN coef c",
        "inv1": """
SELECT *, xi-d1*sin(2*xi)*cosh(2*eta)-d2*sin(4*xi)*cosh(4*eta)-d3*sin(6*xi)*cosh(6*eta)-d4*sin(8*xi)*cosh(8*eta) AS x1,
 eta-d1*cos(2*xi)*sinh(2*eta)-d2*cos(4*xi)*sinh(4*eta)-d3*cos(6*xi)*sinh(6*eta)-d4*cos(8*xi)*sinh(8*eta) AS e1 FROM inv0""",
        "inv2": "SELECT *, asin(sin(x1)/cosh(e1)) AS ps, atan2(sinh(e1),cos(x1)) AS dl FROM inv1",
        "inv": f"""
SELECT {keep}, degrees(ps+sin(ps)*cos(ps)*(ca+cb*power(sin(ps),2)+cc*power(sin(ps),4)+cd*power(sin(ps),6))) AS lat, degrees(dl)+15e0 AS lon FROM inv2""",
    }


def build() -> dict[str, str]:
    s1 = _stage1()
    s2 = {**s1, **_stage2()}
    s3 = {**s1, **_stage2(10), **_stage3()}
    out: dict[str, str] = {}

    # stage 1
    out["locality_events"] = _sql(
        s1,
        """SELECT LocalityID, date_s, LocalityID || '_' || date_s AS checklist_id, COUNT(*) AS n_records,
 COUNT(DISTINCT taxon_id)+MAX(CASE WHEN taxon_id IS NULL THEN 1 ELSE 0 END) AS n_species FROM base WHERE date_s IS NOT NULL GROUP BY LocalityID, date_s""",
    )
    out["scan_occurrence"] = _sql(
        s1,
        """SELECT scientificName, COUNT(*) AS n_records, COUNT(decimalLatitude) AS n_located, COUNT(eventDate) AS n_dated FROM occ GROUP BY 1""",
    )
    out["locality_core"] = _sql(
        s1,
        "SELECT LocalityID, round(lat_r,6) AS lat_r, round(lon_r,6) AS lon_r, first_event, last_event, n_records, n_events, n_species FROM loc",
    )
    out["effort_index"] = _sql(s1, "SELECT LocalityID, round(effort_index,6) AS effort_index FROM eff")
    out["effort_weight"] = _sql(s1, "SELECT LocalityID, round(w_inv,6) AS w_inv FROM weighted")
    out["effort_strata"] = _sql(
        s1, "SELECT LocalityID, round(effort_index,6) AS effort_index, effort_stratum FROM weighted"
    )
    out["strata_histogram"] = _sql(
        s1, "SELECT effort_stratum, COUNT(*) AS n_localities FROM weighted GROUP BY 1"
    )
    out["margalef"] = _sql(
        s1, "SELECT LocalityID, round(Margalef_local,6) AS margalef_local FROM master"
    )
    out["ias_flags"] = _sql(s1, "SELECT LocalityID, n_species_IAS FROM master")
    out["n2k_score"] = _sql(
        s1, "SELECT LocalityID, n_species_N2K, round(n2000_score,6) AS n2000_score FROM master"
    )
    out["dominant_habitat"] = _sql(s1, "SELECT LocalityID, habitat, round(purity,6) AS purity FROM dom")
    doubles = (
        "lat_r lon_r IAS_share_species n2000_score effort_index w_inv Margalef_local Margalef_exIAS "
        "dominant_habitat_purity"
    ).split()
    rest = (
        "LocalityID SWEREF_N SWEREF_E county_id first_event last_event n_records n_events n_species "
        "n_species_IAS n_species_nonIAS n_species_N2K effort_stratum dominant_habitat"
    ).split()
    out["locality_master"] = _sql(s1, f"SELECT {', '.join(rest)}, {_r6(*doubles)} FROM master")

    # scalar functions
    out["taxon_id_extract"] = """
SELECT TRY_CAST(NULLIF(regexp_extract(m,'([0-9]+)$',1),'') AS BIGINT) AS loose, NULLIF(regexp_extract(m,':Taxon:([0-9]+)$',1),'') AS strict, COUNT(*) AS n
FROM (SELECT CASE WHEN l_linenumber%3=0 THEN CAST(l_partkey AS VARCHAR) ELSE 'urn:lsid:dyntaxa.se:Taxon:' || l_partkey END AS m FROM lineitem) q GROUP BY 1,2"""
    out["date_normalize"] = _sql(s1, "SELECT eventDate, date_s, COUNT(*) AS n FROM base GROUP BY 1,2")
    out["date_in_text"] = """
SELECT doc_id, CASE length(tok) WHEN 4 THEN tok || '-01-01' WHEN 7 THEN tok || '-01' ELSE tok END AS date_s
FROM (SELECT doc_id, NULLIF(regexp_extract(text,'([0-9]{4}(-[0-9]{2}){0,2})',1),'') AS tok FROM documents) q"""
    out["cell_key"] = _sql(s1, "SELECT LocalityID, COUNT(*) AS n FROM base GROUP BY 1")
    out["locality_key"] = """
SELECT CASE WHEN l_linenumber=1 THEN 'L' || l_suppkey WHEN l_linenumber=2 THEN 'Site ' || l_suppkey
 ELSE 'cell_' || printf('%.3f', 55e0 + CAST(l_partkey%20000 AS DOUBLE)/10000) || '_' || printf('%.3f', 11e0 + CAST(l_orderkey%20000 AS DOUBLE)/10000) END AS key, COUNT(*) AS n
FROM lineitem GROUP BY 1"""
    slug = "coalesce(NULLIF(trim(regexp_replace(lower({c}),'[^a-z]+','_','g'),'_'),''),'unknown')"
    out["habitat_slug"] = (
        f"SELECT doc_id, md5({slug.format(c='text')}) AS text_slug, "
        + slug.format(c="lang || ' / ' || source")
        + " AS slug FROM documents"
    )
    out["name_keys"] = """
SELECT p_partkey, k AS name_norm, array_to_string(list_slice(string_split(k,' '),1,2),' ') AS gs_key
FROM (SELECT p_partkey, lower(p_name || ' ' || p_type || ' ' || p_brand) AS k FROM part) q"""
    out["safe_name"] = (
        "SELECT page_id, regexp_replace(replace(trim(url),' ','_'),'[^A-Za-z0-9_.åäöÅÄÖ-]','_','g') AS name FROM pages"
    )
    out["stable_seed"] = (
        "SELECT c_custkey, CAST(('0x' || substr(md5(c_name),1,8)) AS BIGINT) + 165 AS seed FROM customer"
    )
    out["lsa_j"] = """
SELECT l_suppkey, m, CAST(CASE WHEN m<30 THEN m ELSE least(80, greatest(30, floor(0.1e0*m)), m) END AS BIGINT) AS j
FROM (SELECT l_suppkey, COUNT(*) AS m FROM lineitem GROUP BY 1) q"""
    out["project_tm"] = _sql({"occ": s1["occ"]}, _PROJECT)
    out["inverse_tm"] = _sql(
        {"occ": s1["occ"], "spots": "SELECT DISTINCT E, N FROM occ", **_inverse("N", "E", "spots", "E, N")},
        "SELECT E, N, round(lat,8) AS lat, round(lon,8) AS lon FROM inv",
    )

    # lookup files
    out["bank_lookup"] = _sql(
        {"taxa": s1["taxa"], "n2k": s1["n2k"]},
        """SELECT taxon_id, CAST(NULL AS VARCHAR) AS habitatCode, round(CASE WHEN weight<>0.25e0 THEN weight ELSE 1e0 END,6) AS weight FROM n2k""",
    )
    out["redlist_ids"] = (
        "SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS taxon_id FROM part WHERE p_size%7=0"
    )
    out["focal_list"] = """
SELECT DISTINCT taxon_id, name FROM (
 SELECT CASE WHEN p_partkey%3<>0 THEN CAST(p_partkey%500 AS VARCHAR) END AS taxon_id, CASE WHEN p_partkey%5<>0 THEN trim(p_name) END AS name FROM part
 UNION ALL SELECT '7', NULL UNION ALL SELECT '100000', NULL UNION ALL SELECT NULL, 'Extra name') q"""
    out["lm_load"] = """
SELECT CAST(CAST(l_quantity AS BIGINT)%10 AS DOUBLE) AS effort_stratum, 'Unknown' AS dominant_habitat, COUNT(*) AS n, round(SUM(l_tax),4) AS w, round(SUM(l_discount),4) AS score
FROM lineitem WHERE l_suppkey%9<>0 AND l_linenumber<>1 GROUP BY 1"""
    out["red_local_load"] = """
SELECT l_returnflag AS folder, 'cell ' || l_suppkey AS LocalityID, COUNT(*) AS n, SUM(CAST(CAST(l_quantity AS BIGINT) AS DOUBLE)) AS value
FROM lineitem WHERE l_linenumber<>7 GROUP BY 1,2"""
    out["parse_totals"] = """
SELECT CAST(p_partkey AS VARCHAR) AS folder, p_name || ' ' || p_type AS focal_id, string_split(p_name || ' ' || p_type,' ')[1] AS genus,
 array_to_string(list_slice(string_split(p_name || ' ' || p_type,' '),2,99),' ') AS species_n,
 CAST(p_partkey AS DOUBLE) AS No_obs, CAST(p_size AS DOUBLE) AS No_asc_spp, 7e0 AS No_redlisted FROM part"""
    out["parse_ids"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS folder, CAST(unnest(regexp_extract_all('Brand#3 ' || o_custkey || ' ' || o_orderpriority,'[0-9]+')) AS BIGINT) AS taxon_id FROM orders"""
    out["parse_locspecies"] = """
SELECT o_orderstatus AS folder, o_orderkey AS pos, CASE WHEN o_orderkey%5=2 THEN '<NA>' ELSE 'cell_x' END AS LocalityID,
 CASE WHEN o_orderkey%5=2 THEN '' ELSE o_custkey || ' ' || o_orderkey END AS ids FROM orders WHERE o_orderkey%5>=2"""

    # stage 2
    out["bbox_filter"] = """
SELECT l_suppkey, COUNT(*) AS n FROM (SELECT l_suppkey, 54e0 + CAST(l_partkey%170 AS DOUBLE)/10 AS lat, 8e0 + CAST(l_orderkey%200 AS DOUBLE)/10 AS lon FROM lineitem) q
WHERE lon BETWEEN 10 AND 25 AND lat BETWEEN 55 AND 69.5 GROUP BY 1"""
    point_counts = "SELECT scientificName AS focal, CAST(taxon_id AS VARCHAR) AS taxon, COUNT(*) AS n FROM base WHERE scientificName {} GROUP BY 1,2"
    out["focal_filter"] = _sql(s1, point_counts.format(f"IN {FOCAL}"))
    out["assoc_filter"] = _sql(s1, point_counts.format(f"NOT IN {FOCAL}"))
    out["red_flag"] = _sql(
        s1,
        f"""SELECT CAST(taxon_id AS VARCHAR) AS taxon, coalesce(taxon_id%7=0,false) AS is_red, COUNT(*) AS n FROM base WHERE scientificName NOT IN {FOCAL} GROUP BY 1,2""",
    )
    out["focal_meta"] = _sql(
        s2,
        """SELECT focal, COUNT(*) AS focal_obs,
 arg_min(v, row_key) FILTER (WHERE part=first_part AND v IS NOT NULL) AS vern, arg_min(t, row_key) FILTER (WHERE part=first_part AND t IS NOT NULL) AS taxon
FROM (SELECT focal, part, row_key, CASE WHEN row_key NOT LIKE '1%' THEN vernacularName END AS v, CAST(taxon_id AS VARCHAR) AS t,
 MIN(part) OVER (PARTITION BY focal) AS first_part FROM focal_pts) q GROUP BY focal""",
    )
    out["site_sample"] = _sql(s2, "SELECT run, focal, fid, LocalityKey, E, N FROM sites")
    out["multi_run"] = _sql(
        {**s1, **_stage2(10)},
        "SELECT run, focal, COUNT(*) AS n_kept, CAST(SUM(n_hits) AS BIGINT) AS n_hits FROM kept GROUP BY 1,2",
    )
    out["bbox_prefilter"] = _sql(
        {
            **s2,
            "box": "SELECT MIN(E)-50 AS e1, MAX(E)+50 AS e2, MIN(N)-50 AS n1, MAX(N)+50 AS n2 FROM sites",
            "corners": "SELECT e1 AS e, n1 AS nn FROM box UNION ALL SELECT e1, n2 FROM box UNION ALL SELECT e2, n1 FROM box UNION ALL SELECT e2, n2 FROM box",
            **_inverse("nn", "e", "corners", "e, nn"),
        },
        """SELECT round(MIN(lon)-0.05e0,6) AS lon_min, round(MIN(lat)-0.05e0,6) AS lat_min, round(MAX(lon)+0.05e0,6) AS lon_max, round(MAX(lat)+0.05e0,6) AS lat_max FROM inv""",
    )
    deg = _degrees()
    out["degrees_found"] = _sql(
        deg,
        """SELECT f.focal, f.n AS focal_obs, coalesce(string_agg(CAST(taxon AS VARCHAR),' ' ORDER BY CAST(taxon AS VARCHAR)),'') AS ids,
 coalesce(string_agg(CAST(taxon AS VARCHAR),' ' ORDER BY CAST(taxon AS VARCHAR)) FILTER (WHERE taxon%7=0),'') AS red_ids,
 COUNT(taxon) AS n_assoc, COUNT(taxon) FILTER (WHERE taxon%7=0) AS n_red
FROM (SELECT name AS focal, COUNT(*) AS n FROM foc GROUP BY 1) f LEFT JOIN keep k ON k.focal=f.focal GROUP BY 1,2""",
    )
    out["degrees_red_local"] = _sql(
        deg, "SELECT focal, loc AS LocalityID, COUNT(DISTINCT taxon) AS n_red FROM near WHERE taxon%7=0 GROUP BY 1,2"
    )
    out["degrees_near"] = _sql(
        deg,
        """SELECT name AS scientificName, COUNT(*) AS n FROM occ
WHERE decimalLatitude BETWEEN (SELECT MIN(decimalLatitude)-0.05e0 FROM foc) AND (SELECT MAX(decimalLatitude)+0.05e0 FROM foc)
 AND decimalLongitude BETWEEN (SELECT MIN(decimalLongitude)-0.05e0 FROM foc) AND (SELECT MAX(decimalLongitude)+0.05e0 FROM foc) GROUP BY 1""",
    )
    site_inv = _inverse("N", "E", "sites", "run, focal, fid")
    out["near_buffers"] = _sql(
        {**s2, **site_inv},
        """SELECT scientificName, COUNT(*) AS n FROM occ WHERE decimalLatitude BETWEEN (SELECT MIN(lat)-2e0 FROM inv) AND (SELECT MAX(lat)+2e0 FROM inv)
 AND decimalLongitude BETWEEN (SELECT MIN(lon)-2e0 FROM inv) AND (SELECT MAX(lon)+2e0 FROM inv) GROUP BY 1""",
    )
    out["buffer_join"] = _sql(
        s2,
        "SELECT focal, fid, CAST(taxon_id AS VARCHAR) AS taxon, LocalityID AS LocalityKey, is_red, COUNT(*) AS n_hits FROM hits GROUP BY 1,2,3,4,5",
    )
    out["region_filter"] = _sql(
        {
            **s1,
            "nat": "SELECT DISTINCT 500000e0+s_nationkey*397 AS x0, 6580000e0+s_nationkey*311 AS y0, s_nationkey AS k FROM supplier",
            "inside": """
SELECT b.scientificName AS focal, bool_or((b.E BETWEEN x0 AND x0+900 AND b.N BETWEEN y0 AND y0+900 AND NOT (b.E>x0+300 AND b.E<x0+600 AND b.N>y0+300 AND b.N<y0+600))
 OR (b.E>=x0-500 AND b.N>=y0-500 AND (b.E-x0+500)+(b.N-y0+500)<=900)) AS hit FROM (SELECT *, row_number() OVER () AS id FROM base) b CROSS JOIN nat GROUP BY b.id, b.scientificName""",
        },
        "SELECT focal, COUNT(*) AS n FROM inside WHERE hit GROUP BY 1",
    )
    out["assoc_freq"] = _sql(s2, "SELECT focal, CAST(taxon_id AS VARCHAR) AS taxon, n_hits FROM kept")
    out["unique_finds"] = _sql(s2, "SELECT focal, ids FROM found")
    out["red_finds"] = _sql(s2, "SELECT focal, red_ids AS ids FROM found")
    out["total_target_obs"] = _sql(s2, "SELECT focal, focal_obs, n_assoc, n_red FROM found")
    out["all_observations"] = _sql(
        s2,
        "SELECT h.focal, CAST(h.taxon_id AS VARCHAR) AS taxon FROM hits h JOIN kept k ON h.focal=k.focal AND h.taxon_id=k.taxon_id",
    )
    out["red_species_local"] = _sql(s2, "SELECT focal, LocalityID, n_red FROM red_loc")
    out["locality_species_all"] = _sql(
        s2,
        """SELECT s.focal, s.fid, coalesce(s.LocalityKey,'<NA>') AS LocalityID, CAST(s.N AS BIGINT) AS SWEREF_N, CAST(s.E AS BIGINT) AS SWEREF_E, coalesce(h.ids,'') AS ids
FROM sites s LEFT JOIN (SELECT focal, fid, string_agg(CAST(taxon_id AS VARCHAR),' ' ORDER BY taxon_id) AS ids FROM (SELECT DISTINCT focal, fid, taxon_id FROM hits WHERE taxon_id IS NOT NULL) d GROUP BY 1,2) h
 ON s.focal=h.focal AND s.fid=h.fid""",
    )
    out["locality_species_red"] = _sql(
        {
            **s2,
            "blank": "SELECT row_number() OVER () AS id, * FROM hits WHERE is_red",
            **_inverse("N", "E", "blank", "id"),
            "named": """
SELECT b.*, coalesce(LocalityID, 'cell_' || printf('%.3f', i.lat) || '_' || printf('%.3f', i.lon)) AS loc FROM blank b JOIN inv i USING (id)""",
        },
        """SELECT focal, loc AS LocalityID, CAST(round_even(median(N),0) AS BIGINT) AS SWEREF_N, CAST(round_even(median(E),0) AS BIGINT) AS SWEREF_E,
 array_to_string(list_sort(list_distinct(list(CAST(taxon_id AS VARCHAR)))),' ') AS ids FROM named GROUP BY 1,2""",
    )

    # stage 3
    out["focal_localities"] = _sql(
        s3,
        "SELECT folder, LocalityID, value, round(w_inv,6) AS w_inv, CAST(effort_stratum AS DOUBLE) AS effort_stratum, dominant_habitat FROM fl",
    )
    out["exceedance"] = """
SELECT l_returnflag, CAST(t AS INTEGER) AS t, SUM(CASE WHEN v>t THEN 1e0 ELSE 0e0 END) AS n_above, COUNT(*) AS n FROM (
 SELECT l_suppkey, l_returnflag, COUNT(DISTINCT l_linenumber) AS v FROM lineitem GROUP BY 1,2) q CROSS JOIN (SELECT unnest(range(16)) AS t) r GROUP BY 1,2"""
    out["a1_background"] = _sql(
        s3,
        f"SELECT h.folder, h.main_hab, b.n AS b_n, {_tallies('b', 'b')} FROM fh h JOIN b_tot b ON b.folder=h.folder",
    )
    out["a1_point"] = _sql(
        s3,
        f"SELECT folder, main_hab, n_focal, n_background, {_r6('mean_loglift', 'lifted', 'frac')}, A1_debug FROM a1",
    )
    out["a5_split"] = _sql(
        s3,
        f"""SELECT p.folder, p.pool, p.np AS n_pool_localities, coalesce(o.n,0) AS o_n, coalesce(b.n,0) AS b_n, {_tallies('o', 'o')}, {_tallies('b', 'b')}
FROM (SELECT folder, pool, COUNT(*) AS np FROM pool GROUP BY 1,2) p LEFT JOIN a5_sets o ON o.folder=p.folder AND o.own LEFT JOIN a5_sets b ON b.folder=p.folder AND NOT b.own""",
    )
    out["a5_point"] = _sql(
        s3,
        "SELECT folder, pool, n_in_pool, n_rest, round(mean_loglift,6) AS n2k_mean_loglift, A5_debug FROM a5",
    )
    out["a1_ci"] = _sql(
        {**s3, **_a1_intervals()},
        f"SELECT folder, {_ends('mean_loglift:mean_loglift', 'lifted:lifted', 'frac:frac')} FROM boot GROUP BY folder",
    )
    out["a5_ci"] = _sql(
        {**s3, **_a5_intervals()},
        f"SELECT folder, {_ends('mean_loglift:n2k')} FROM boot GROUP BY folder",
    )
    out["infer_habitat"] = _sql(
        {
            "raw": """
SELECT p_partkey AS r, CASE WHEN p_partkey%4<>0 THEN CAST(p_partkey%700 AS DOUBLE) END AS t,
 lower(CASE WHEN p_size%2=0 THEN p_name || ' ' || p_size ELSE p_brand || ' ' || p_type || ' ' || p_size END) AS nm,
 CASE WHEN p_size%11<>0 THEN 'hab' || (p_partkey%9) END AS habitat FROM part""",
            "m1": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r) AS k FROM raw WHERE habitat IS NOT NULL) q WHERE k=1",
            "m2": "SELECT r, nm, habitat FROM (SELECT r, nm, habitat, row_number() OVER (PARTITION BY nm ORDER BY r) AS k2 FROM m1) q WHERE k2=1",
            "m3": "SELECT gs, habitat FROM (SELECT *, row_number() OVER (PARTITION BY gs ORDER BY r) AS k3 FROM (SELECT r, habitat, array_to_string(list_slice(string_split(nm,' '),1,2),' ') AS gs FROM m2) a) q WHERE k3=1",
            "f": """
SELECT CAST(p_partkey AS VARCHAR) AS folder, CASE p_partkey%3 WHEN 0 THEN upper(p_name) || '  ' || p_size WHEN 1 THEN p_brand || ' ' || p_type || ' ssp' ELSE p_name || 'us' END AS focal_id FROM part""",
            "g": "SELECT *, regexp_replace(lower(focal_id),' +',' ','g') AS nm FROM f",
        },
        """SELECT folder, focal_id, coalesce(a.habitat, b.habitat, 'Unknown') AS main_hab FROM g LEFT JOIN m2 a ON a.nm=g.nm
LEFT JOIN m3 b ON b.gs=array_to_string(list_slice(string_split(g.nm,' '),1,2),' ')""",
    )
    out["habitat_purity"] = _sql(s3, f"SELECT folder, {_r6('Habitat_purity')} FROM purity")
    out["bg_alloc"] = """
WITH li AS (SELECT CAST(l_suppkey AS VARCHAR) AS folder, l_suppkey, CAST(l_linenumber AS INTEGER) AS rep, CAST(l_quantity AS BIGINT)%10 AS stratum FROM lineitem),
d AS (SELECT folder, rep, stratum, COUNT(*) AS k, SUM(COUNT(*)) OVER (PARTITION BY folder, rep) AS n FROM li GROUP BY 1,2,3)
SELECT d.folder, rep, d.stratum, k, CASE WHEN EXISTS (SELECT 1 FROM li x WHERE x.folder=d.folder AND x.stratum=d.stratum AND l_suppkey%7<>stratum)
 THEN CAST(round_even(CAST(k AS DOUBLE)/CAST(n AS DOUBLE)*(SELECT least(COUNT(*),1000) FROM li y WHERE y.folder=d.folder),0) AS BIGINT) ELSE 0 END AS alloc FROM d"""
    lsa = {
        **s1,
        **_stage2(10),
        "locs": f"""
SELECT {_folder('s.focal', 's.run')} AS folder, s.fid, h.taxon_id FROM sites s
LEFT JOIN (SELECT DISTINCT run, focal, fid, taxon_id FROM hits WHERE taxon_id IS NOT NULL) h ON h.run=s.run AND h.focal=s.focal AND h.fid=s.fid""",
        "per_loc": "SELECT folder, fid, COUNT(taxon_id) AS n, COUNT(*) OVER (PARTITION BY folder) AS m FROM locs GROUP BY folder, fid",
        "drawn": """
SELECT * FROM (SELECT folder, rep, fid, n, m, CASE WHEN m<30 THEN m ELSE least(80, greatest(30, floor(0.1e0*m)), m) END AS j,
 row_number() OVER (PARTITION BY folder, rep ORDER BY md5('165|' || folder || '|' || rep || '|' || fid), fid) AS rn
 FROM per_loc CROSS JOIN (SELECT unnest(range(1,11)) AS rep) r) q WHERE rn<=j""",
        "reps": """
SELECT d.folder, d.rep, MAX(m) AS m, CAST(MAX(j) AS BIGINT) AS j, AVG(n) AS alpha,
 CAST((SELECT COUNT(DISTINCT l.taxon_id) FROM drawn x JOIN locs l ON l.folder=x.folder AND l.fid=x.fid WHERE x.folder=d.folder AND x.rep=d.rep) AS DOUBLE) AS gamma
FROM drawn d GROUP BY d.folder, d.rep""",
    }

    def summary(x: str, stem: str, short: str) -> str:
        base = f"greatest(abs(AVG({x})),1e-12)"
        return (
            f"round(AVG({x}),6) AS {stem}_mean, round(stddev_samp({x}),6) AS {stem}_sd, round(stddev_samp({x})/{base},6) AS {short}_cv, "
            f"round((MAX({x})-MIN({x}))/{base},6) AS {short}_norm_range, round(MIN({x}),6) AS {stem}_min, round(MAX({x}),6) AS {stem}_max, "
            f"round(MAX({x})-MIN({x}),6) AS {stem}_range"
        )

    summed = f"""SELECT folder, 'OK' AS LSA_debug, MAX(m) AS LSA_m_localities, MAX(j) AS LSA_j_subsample, COUNT(*) AS LSA_repeats,
 {summary('gamma', 'gamma_unique_species', 'gamma')}, {summary('alpha', 'alpha_mean_spp_per_locality', 'alpha')} FROM reps GROUP BY folder"""
    out["lsa_summary"] = _sql(lsa, summed)
    zs = _r6(*_METRICS.values())
    out["robust_z"] = _sql(
        {**METRIC_ROWS, **_scored("metric_rows")}, f"SELECT folder, main_hab, {zs} FROM scored"
    )
    out["jenks"] = _sql(
        {
            **METRIC_ROWS,
            "by_brand": "SELECT brand, round(AVG(q)-25.4e0,6) AS x FROM metric_rows GROUP BY brand",
            **_breaks("by_brand", "x"),
        },
        f"SELECT brand, x, {_class('by_brand.x')} AS x_class FROM by_brand",
    )
    comp = {
        **s3,
        "rows_": """
SELECT h.folder, h.focal AS focal_id, h.main_hab, CAST(d.focal_obs AS DOUBLE) AS No_obs, CAST(d.n_assoc AS DOUBLE) AS No_asc_spp, CAST(d.n_red AS DOUBLE) AS No_redlisted,
 a1.n_focal, a1.n_background, (SELECT COUNT(*) FROM pool p WHERE p.folder=h.folder) AS n_pool_localities,
 Habitat_purity, a1.mean_loglift, a5.mean_loglift AS n2k_mean_loglift, A1_debug, A5_debug
FROM fh h JOIN found d ON d.focal=h.focal AND d.run=h.run JOIN a1 ON a1.folder=h.folder LEFT JOIN a5 ON a5.folder=h.folder LEFT JOIN purity p ON p.folder=h.folder""",
        **_scored("rows_"),
        **_breaks("scored", "composite_index"),
    }
    out["composite_index"] = _sql(
        comp,
        f"""SELECT folder, focal_id, main_hab, No_obs, No_asc_spp, No_redlisted, n_focal, n_background, n_pool_localities,
 {_r6('Habitat_purity', 'mean_loglift', 'n2k_mean_loglift')}, {zs}, {_r6('composite_index')}, {_class('scored.composite_index')} AS composite_class, A1_debug, A5_debug FROM scored""",
    )
    a1_ends = _ends("mean_loglift:mean_loglift", "lifted:lifted", "frac:frac")
    inner = {k: v for k, v in lsa.items() if k in ("locs", "per_loc", "drawn", "reps")}
    scores = ["Habitat_purity", "mean_loglift", "lifted", "frac", "n2k_mean_loglift"]
    out["composite_full"] = _sql(
        {
            **comp,
            "ci1": f"SELECT * FROM ({_sql(_a1_intervals(), f'SELECT folder, {a1_ends} FROM boot GROUP BY folder')}) q",
            "ci5": f"SELECT * FROM ({_sql(_a5_intervals(), f'SELECT folder, {_ends('mean_loglift:n2k')} FROM boot GROUP BY folder')}) q",
            "lsa_": f"SELECT * FROM ({_sql(inner, summed)}) q",
        },
        f"""SELECT s.folder, focal_id, main_hab, No_obs, No_asc_spp, No_redlisted, n_focal, n_background, n_pool_localities,
 {_r6(*scores)}, {zs}, {_r6('composite_index')}, {_class('s.composite_index')} AS composite_class, A1_debug, A5_debug,
 ci1.* EXCLUDE (folder), ci5.* EXCLUDE (folder), lsa_.* EXCLUDE (folder)
FROM (SELECT c.*, a1.lifted, a1.frac FROM scored c JOIN a1 USING (folder)) s LEFT JOIN ci1 ON ci1.folder=s.folder LEFT JOIN ci5 ON ci5.folder=s.folder LEFT JOIN lsa_ ON lsa_.folder=s.folder""",
    )
    out["habitat_summary"] = _sql(
        {**METRIC_ROWS, **_scored("metric_rows")},
        """SELECT main_hab, COUNT(composite_index) AS n, round(AVG(composite_index),6) AS mean, round(stddev_samp(composite_index),6) AS std,
 round(MIN(composite_index),6) AS min, round(quantile_cont(composite_index,0.25),6) AS q25, round(quantile_cont(composite_index,0.5),6) AS q50,
 round(quantile_cont(composite_index,0.75),6) AS q75, round(MAX(composite_index),6) AS max FROM scored GROUP BY 1""",
    )

    # stage 4
    out["runs_load"] = _sql(RUNS, "SELECT focal_id, value, value_class FROM runs WHERE value IS NOT NULL")
    out["undersample_filter"] = _sql(
        RUNS,
        """SELECT (SELECT COUNT(*) FROM runs WHERE No_obs>=350) AS kept_rows,
 (SELECT COUNT(*) FROM (SELECT DISTINCT focal_id FROM runs EXCEPT SELECT DISTINCT focal_id FROM runs WHERE No_obs>=350) q) AS removed_groups""",
    )
    out["stability_scores"] = _sql({**RUNS, **_stability("true")}, f"SELECT {_STAB_COLS} FROM stab")
    report = {**RUNS, **_stability("No_obs>=350"), **_breaks("stab", "mean")}
    out["stability_report"] = _sql(
        report,
        f"""SELECT {_STAB_COLS}, {_class('stab.mean')} AS mean_class, CASE WHEN mean>=0 THEN CASE WHEN {_class('stab.mean')}>=3 THEN 1e0 ELSE 0e0 END END AS mean_class3plus,
 round({_SCORE},10) AS stability_score, round(relative_sd*(1-{_SCORE}),10) AS instability_score FROM stab""",
    )
    out["top_unstable"] = _sql(
        report,
        f"""SELECT focal_id, n_runs, round(mean,10) AS mean, round(sd,10) AS sd, round(range,10) AS range, round(relative_sd,10) AS relative_sd,
 round(relative_sd*(1-{_SCORE}),10) AS instability_score FROM stab ORDER BY relative_sd*(1-{_SCORE}) DESC NULLS LAST, stab.sd DESC NULLS LAST, focal_id LIMIT 20""",
    )
    return out
