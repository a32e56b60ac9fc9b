"""DuckDB SQL for the registered queries.

The SQL never parses CIGAR, MD or SAM text: it computes every base from the closed formula of the
derived reads, so the text handling of the library is checked independently.
"""

from __future__ import annotations


def _x(p: str) -> str:
    return f"({p} * {p} * 3 + {p} * 5 + ({p} * {p} * {p}) % 11 + c)"


def _letter(p: str, shift: int) -> str:
    return f"substr('ACGT', CAST(1 + ({_x(p)} + {shift}) % 4 AS INT), 1)"


_LAYOUT = """
all_r AS (
  SELECT *, len // 2 AS h,
         CASE shape WHEN 5 THEN len + 2 WHEN 6 THEN len - 1 WHEN 7 THEN len - 2 ELSE len END AS span
  FROM (
    SELECT l_orderkey AS ok, 1 + l_suppkey % 4 AS c, 'chr' || (1 + l_suppkey % 4) AS contig,
           (l_partkey * 37 + l_linenumber * 11) % 2000 AS s,
           CAST(floor(l_quantity) AS BIGINT) AS len,
           CASE WHEN floor(l_quantity) < 6 THEN 1 ELSE l_linenumber END AS shape,
           CASE WHEN l_linestatus = 'F' THEN 'tumor' ELSE 'normal' END AS sample,
           CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS token,
           20 + l_orderkey % 41 AS mapq,
           l_orderkey % 17 = 0 AS is_dup, l_orderkey % 23 = 0 AS fail_qc, l_returnflag <> 'R' AS fwd
    FROM lineitem)),
r AS (SELECT *, s + span AS e FROM all_r WHERE NOT is_dup AND NOT (shape = 7 AND s < 1))"""

_BASES = f"""
b AS (
  SELECT *, {_letter('p', 0)} AS ref_base,
         CASE WHEN shape = 5 AND j >= h AND j < h + 2 THEN ''
              WHEN (ok * 7 + p * 13) % 211 = 0 THEN {_letter('p', 2)}
              WHEN p % 89 = 5 OR (p % 97 = 13 AND ok % 2 = 0)
                   OR (p % 101 = 7 AND sample = 'tumor' AND ok % 3 = 0) THEN {_letter('p', 1)}
              ELSE {_letter('p', 0)} END AS base
  FROM (SELECT r.*, t.j, r.s + t.j AS p FROM r, unnest(range(0, r.span)) AS t(j))),
el AS (
  SELECT contig, p AS locus, sample, token, mapq, fwd, ref_base, ok, j, h, shape, base,
         CASE WHEN base = '' THEN 'deletion' WHEN shape = 6 AND j = h - 1 THEN 'insertion'
              WHEN base = ref_base THEN 'match' ELSE 'mismatch' END AS kind,
         CASE WHEN shape = 6 AND j = h - 1 THEN base || 'T' ELSE base END AS allele,
         CASE WHEN base = '' THEN mapq
              WHEN shape = 6 AND j = h - 1 THEN least(2 + (ok * 3 + j * 5) % 40, 2 + ok % 40)
              ELSE 2 + (ok * 3 + j * 5) % 40 END AS q
  FROM b)"""

READS = f"WITH {_LAYOUT}"
ELEMENTS = f"WITH {_LAYOUT}, {_BASES}"

_RANGES = """
rg AS (
  SELECT 'chr' || (1 + o_custkey % 4) AS contig, (o_orderkey * 7919 + o_custkey * 31) % 200000 AS s,
         (o_orderkey * 7919 + o_custkey * 31) % 200000 + 1 + o_custkey % 40 AS e, o_orderstatus AS v
  FROM orders)"""
_TARGETS = """
tg AS (
  SELECT 'chr' || (1 + s_suppkey % 4) AS contig, (s_suppkey * 37) % 2000 AS s,
         (s_suppkey * 37) % 2000 + 1 + s_suppkey % 7 AS e, s_nationkey % 5 AS v
  FROM supplier)"""


def _merged(name: str, source: str, keys: str = "contig") -> str:
    """CTEs that fuse touching and overlapping ``s, e`` rows of ``source`` into ``name``."""
    return f"""
{name}_a AS (
  SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
{name}_b AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END)
         OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {name}_a),
{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM {name}_b GROUP BY {keys}, island)"""


def _overlaid(name: str, source: str, order: str = "0") -> str:
    """CTEs for the later-starting-wins map of ``source`` (``s, e, v``), one locus at a time."""
    return f"""
{name}_l AS (
  SELECT contig, p, arg_max(v, (s, {order}, v)) AS v
  FROM (SELECT *, unnest(range(s, e)) AS p FROM {source}) GROUP BY contig, p),
{name}_p AS (SELECT contig, p AS s, p + 1 AS e, v FROM {name}_l),
{_merged(name, name + '_p', 'contig, v')}"""


def _log_copies(k: int, ploidy: int) -> str:
    """Integer log of k copies (1 - e) and the others e, per element; null where it is impossible."""
    return (
        f"CAST(floor(ln(CASE WHEN {k} * (1 - pow(10, -q / 10.0)) + {ploidy - k} * pow(10, -q / 10.0) > 0 "
        f"THEN {k} * (1 - pow(10, -q / 10.0)) + {ploidy - k} * pow(10, -q / 10.0) END) * {_LOG} + 0.5) AS BIGINT)"
    )


_WIDE = """
rg AS (
  SELECT 'chr' || (1 + o_custkey % 4) AS contig, (o_orderkey * 7919 + o_custkey * 31) % 200000000 AS s,
         (o_orderkey * 7919 + o_custkey * 31) % 200000000 + CASE WHEN o_orderkey % 200 = 0
           THEN 1000000 * (1 + (o_orderkey // 200) % 100)
           ELSE (1 + o_custkey % 40) * CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 1000 END END AS e,
         o_orderstatus AS v
  FROM orders),
pt AS (
  SELECT 'chr' || (1 + l_suppkey % 4) AS contig, (l_orderkey * 104729 + l_partkey * 37 + l_linenumber) % 200000000 AS locus
  FROM lineitem)"""


def _overlaid_wide(name: str, source: str, order: str = "0") -> str:
    """As :func:`_overlaid`, one stretch between neighbouring endpoints at a time."""
    return f"""
{name}_x AS (SELECT DISTINCT contig, unnest([s, e]) AS x FROM {source}),
{name}_y AS (SELECT contig, x, lead(x) OVER (PARTITION BY contig ORDER BY x) AS y FROM {name}_x),
{name}_p AS (
  SELECT q.contig, x AS s, y AS e, arg_max(v, (g.s, {order}, v)) AS v
  FROM {name}_y q JOIN {source} g ON g.contig = q.contig AND g.s <= x AND g.e > x GROUP BY q.contig, x, y),
{_merged(name, name + '_p', 'contig, v')}"""


def _even(name: str, source: str, buckets: str) -> str:
    """CTEs for the even split of the merged ranges ``source`` into ``name`` (with ``pos0``)."""
    edge = "CAST(floor({k} * per + 0.5) AS BIGINT)"
    return f"""
{name}_o AS (
  SELECT contig, s, e, sum(e - s) OVER (ORDER BY contig, s) - (e - s) AS off,
         sum(e - s) OVER () AS total FROM {source}),
{name}_p AS (
  SELECT *, greatest(1.0::DOUBLE, total::DOUBLE / ({buckets})::DOUBLE) AS per FROM {name}_o),
{name}_k AS (
  SELECT *, unnest(range(greatest(CAST(floor(off / per) AS BIGINT) - 1, 0),
                         CAST(floor((off + e - s) / per) AS BIGINT) + 2)) AS k FROM {name}_p),
{name} AS (
  SELECT contig, s + lo - off AS s, s + hi - off AS e, k AS v, lo AS pos0
  FROM (SELECT *, greatest(off, {edge.format(k='k')}) AS lo,
               least(off + e - s, {edge.format(k='(k + 1)')}) AS hi FROM {name}_k)
  WHERE lo < hi)"""


_CONTIG_LOCI = "cl AS (SELECT contig, 0 AS s, max(e) AS e FROM r GROUP BY contig)"


def _big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


# Threshold calls -----------------------------------------------------------------------------


def _threshold(threshold: int, emit: bool) -> str:
    counts = f"""
cnt AS (
  SELECT contig, locus, sample, CASE WHEN kind IN ('match', 'mismatch') THEN base END AS a,
         count(*) AS n, count(*) FILTER (fwd) AS nf, max(ref_base) AS ref
  FROM el GROUP BY ALL),
loc AS (
  SELECT contig, locus, sample, sum(n) AS depth, sum(nf) AS depth_fwd, max(ref) AS ref
  FROM cnt GROUP BY ALL),
pas AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.contig, c.locus, c.sample ORDER BY n DESC, a) AS rk
  FROM cnt c JOIN loc l USING (contig, locus, sample)
  WHERE a IS NOT NULL AND (n * 100) // depth > {threshold}),
top AS (
  SELECT l.*, p1.a AS a1, p1.n AS n1, p2.a AS a2, p2.n AS n2
  FROM loc l
  LEFT JOIN pas p1 ON p1.rk = 1 AND (l.contig, l.locus, l.sample) = (p1.contig, p1.locus, p1.sample)
  LEFT JOIN pas p2 ON p2.rk = 2 AND (l.contig, l.locus, l.sample) = (p2.contig, p2.locus, p2.sample)),
calls AS (
  SELECT contig, locus, sample, ref, depth, depth_fwd, a1 AS alt, 'Alt/Alt' AS alleles, n1 AS n
  FROM top WHERE a1 IS NOT NULL AND a2 IS NULL AND a1 <> ref
  UNION ALL
  SELECT contig, locus, sample, ref, depth, depth_fwd, CASE WHEN a1 = ref THEN a2 ELSE a1 END, 'Ref/Alt',
         CASE WHEN a1 = ref THEN n2 ELSE n1 END
  FROM top WHERE a2 IS NOT NULL AND (a1 = ref OR a2 = ref)
  UNION ALL
  SELECT contig, locus, sample, ref, depth, depth_fwd, unnest([a1, a2]), 'Alt/OtherAlt', unnest([n1, n2])
  FROM top WHERE a2 IS NOT NULL AND a1 <> ref AND a2 <> ref"""
    if emit:
        counts += """
  UNION ALL
  SELECT contig, locus, sample, ref, depth, depth_fwd, ref, 'Ref/Ref', n1 FROM top WHERE a1 = ref AND a2 IS NULL
  UNION ALL
  SELECT contig, locus, sample, ref, depth, depth_fwd, ref, 'NoCall/NoCall', NULL FROM top WHERE a1 IS NULL"""
    return f"{ELEMENTS}, {counts}),\n{_CALL_COLUMNS}"


_CALL_COLUMNS = """
gt AS (
  SELECT contig, CAST(locus AS BIGINT) AS pos, ref, alt, sample, alleles, CAST(depth AS INTEGER) AS read_depth,
         CAST(n AS INTEGER) AS alt_read_depth, CAST(depth_fwd AS INTEGER) AS fwd_reads
  FROM calls)"""

_SOMATIC_THRESHOLD = f"""{ELEMENTS},
cnt AS (
  SELECT contig, locus, CASE WHEN kind IN ('match', 'mismatch') THEN base END AS a,
         count(*) FILTER (token = 1) AS nt, count(*) FILTER (token = 2) AS nn,
         count(*) FILTER (token = 1 AND fwd) AS nf, max(ref_base) AS ref
  FROM el GROUP BY ALL),
loc AS (
  SELECT contig, locus, sum(nt) AS depth, sum(nn) AS depth_n, sum(nf) AS depth_fwd, max(ref) AS ref
  FROM cnt GROUP BY ALL HAVING sum(nt) > 0 AND sum(nn) > 0),
pas AS (
  SELECT c.contig, c.locus, l.ref, l.depth, l.depth_fwd, a, nt,
         row_number() OVER w AS rk, count(*) OVER (PARTITION BY c.contig, c.locus) AS k
  FROM cnt c JOIN loc l USING (contig, locus)
  WHERE a IS NOT NULL AND a <> l.ref AND 100.0 * nn / depth_n < 4 AND 100.0 * nt / depth > 10
  WINDOW w AS (PARTITION BY c.contig, c.locus ORDER BY nt DESC, a)),
calls AS (
  SELECT contig, locus, 'somatic' AS sample, ref, depth, depth_fwd, a AS alt, nt AS n,
         CASE WHEN k = 1 THEN 'Alt/Ref' ELSE 'Alt/OtherAlt' END AS alleles
  FROM pas WHERE rk <= 2),
{_CALL_COLUMNS}
SELECT * FROM gt"""

_BASE_ROWS = """
br AS (
  SELECT contig, locus, token, fwd, CASE WHEN base = '' THEN NULL ELSE base END AS base,
         CASE WHEN base = '' THEN NULL ELSE 2 + (ok * 3 + j * 5) % 40 END AS bq
  FROM el)"""
_TOP = """
bc AS (SELECT contig, locus, token, base, count(*) AS n FROM br WHERE coalesce(bq, 20) >= 20 GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER w AS rk, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(n) OVER (PARTITION BY contig, locus, token) AS depth
  FROM bc WINDOW w AS (PARTITION BY contig, locus, token ORDER BY n DESC, base ASC NULLS LAST)),
tb AS (SELECT * FROM ranked WHERE before = 0 OR (before * 100) // depth < 90)"""

_LOG = "1000000000.0"
_ALLELES = f"""
ev AS (
  SELECT contig, locus, sample, allele, count(*) AS n, count(*) FILTER (fwd) AS nf, max(ref_base) AS ref,
         CAST(sum(CAST(round(ln(2.0 * (1.0 - pow(10.0, -q / 10.0))) * {_LOG}) AS BIGINT)) AS BIGINT) AS hit,
         CAST(sum(CAST(round(ln(2.0 * pow(10.0, -q / 10.0)) * {_LOG}) AS BIGINT)) AS BIGINT) AS miss
  FROM el WHERE keep GROUP BY contig, locus, sample, allele),
tot AS (
  SELECT contig, locus, sample, sum(n) AS depth, sum(nf) AS depth_fwd, max(ref) AS ref, sum(miss) AS all_miss
  FROM ev GROUP BY ALL),
pairs AS (
  SELECT a.contig, a.locus, a.sample, a.allele AS a1, b.allele AS a2, t.depth, t.depth_fwd, t.ref,
         CASE WHEN a.allele = b.allele THEN a.hit + t.all_miss - a.miss
              ELSE t.all_miss - a.miss - b.miss END AS units
  FROM ev a JOIN ev b ON (a.contig, a.locus, a.sample) = (b.contig, b.locus, b.sample) AND a.allele <= b.allele
  JOIN tot t ON (a.contig, a.locus, a.sample) = (t.contig, t.locus, t.sample))"""


def _bayes(keep: str = "mapq > 30", emit_ref: bool = False, prior: str = "0", extra: str = "") -> str:
    alts = "list_filter(list_distinct([a1, a2]), lambda x: x <> ref)"
    if emit_ref:
        alts = f"CASE WHEN a1 = ref AND a2 = ref THEN [ref] ELSE {alts} END"
    source = ELEMENTS.replace("el AS (", "el0 AS (")
    return f"""{source}{extra},
el AS (SELECT *, {keep} AS keep FROM {'el1' if extra else 'el0'}),
{_ALLELES},
best AS (
  SELECT * FROM pairs
  QUALIFY row_number() OVER (PARTITION BY contig, locus, sample
                             ORDER BY units + {prior} DESC, a1, a2) = 1),
calls0 AS (
  SELECT *, CASE WHEN a1 = ref AND a2 = ref THEN 'Ref/Ref' WHEN a1 = a2 THEN 'Alt/Alt'
                 WHEN a1 <> ref AND a2 <> ref THEN 'Alt/OtherAlt' ELSE 'Ref/Alt' END AS alleles
  FROM best),
calls1 AS (SELECT *, unnest({alts}) AS alt FROM calls0),
calls AS (
  SELECT c.*, e.n FROM calls1 c
  LEFT JOIN ev e ON (c.contig, c.locus, c.sample, c.alt) = (e.contig, e.locus, e.sample, e.allele)),
{_CALL_COLUMNS}"""


_FILTERED = """,
el1 AS (
  SELECT * FROM (
    SELECT *, 100.0 * count(*) FILTER (mapq <= 25) OVER w / count(*) OVER w AS share
    FROM (SELECT *, max(dr) OVER (PARTITION BY contig, locus, sample) AS n_alleles
          FROM (SELECT *, dense_rank() OVER (PARTITION BY contig, locus, sample ORDER BY allele) AS dr FROM el0))
    WHERE n_alleles <= 4 WINDOW w AS (PARTITION BY contig, locus, sample))
  WHERE share <= 20)"""

_TRUTH = f"""
tl AS (SELECT contig, CAST(substr(contig, 4) AS BIGINT) AS c, unnest(range(0, max(e))) AS p FROM r GROUP BY contig),
tr AS (
  SELECT contig, p AS pos, {_letter('p', 0)} AS ref, {_letter('p', 1)} AS alt,
         CASE WHEN p % 89 = 5 THEN 'HOM_ALT' ELSE 'HET' END AS kind
  FROM tl WHERE p % 89 = 5 OR p % 97 = 13 OR p % 101 = 7)"""

def _matched(where: str) -> str:
    return f"""
cs AS (
  SELECT contig, pos, ref, alt, max(CASE WHEN contains(alleles, 'Ref') THEN 'HET' ELSE 'HOM_ALT' END) AS kind
  FROM gt WHERE length(ref) = 1 AND length(alt) = 1 AND {where} GROUP BY ALL),
mt AS (
  SELECT coalesce(cs.kind, 'NO_CALL') AS called, coalesce(tr.kind, 'NO_CALL') AS truth, count(*) AS variants
  FROM cs FULL OUTER JOIN tr ON (cs.contig, cs.pos, cs.ref, cs.alt) = (tr.contig, tr.pos, tr.ref, tr.alt)
  GROUP BY ALL)"""


_SCORES = f"""
sc AS (
  SELECT coalesce(sum(variants) FILTER (called <> 'NO_CALL' AND truth <> 'NO_CALL'), 0)::DOUBLE AS tp,
         coalesce(sum(variants) FILTER (truth = 'NO_CALL'), 0)::DOUBLE AS fp,
         coalesce(sum(variants) FILTER (called = 'NO_CALL'), 0)::DOUBLE AS fn FROM mt)
SELECT {_big('tp', 'true_positives')}, {_big('fp', 'false_positives')}, {_big('fn', 'false_negatives')},
       round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall,
       round(2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1
FROM sc"""

# Reduced rows for the pileup filters: mapping quality 58 and better is made ambiguous.
_EVIDENCE = f"""{ELEMENTS},
ev AS (
  SELECT contig, locus, sample, allele, CASE WHEN mapq >= 58 THEN 0 ELSE mapq END AS mapq, count(*) AS n
  FROM el GROUP BY ALL),
loc AS (
  SELECT contig, locus, sample, min(mapq) AS low, count(DISTINCT allele) AS alleles,
         100.0 * sum(CASE WHEN mapq <= 30 THEN n ELSE 0 END) / sum(n) AS share,
         100.0 * sum(CASE WHEN mapq <= 25 THEN n ELSE 0 END) / sum(n) AS share25
  FROM ev GROUP BY ALL)"""


def _kept(locus: str = "TRUE", element: str = "TRUE") -> str:
    return f"""{_EVIDENCE}
SELECT contig, locus, sample, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT allele) AS alleles,
       CAST(min(mapq) AS INTEGER) AS min_mapq
FROM ev JOIN loc USING (contig, locus, sample) WHERE {locus.replace('alleles', 'loc.alleles')} AND {element}
GROUP BY contig, locus, sample"""



_BALANCED = f"""{READS}, {_CONTIG_LOCI},
{_even('mi', 'cl', 'least(4 * 25, total)')},
hits AS (
  SELECT v AS micro, count(*) AS reads FROM (
    SELECT DISTINCT mi.v, r.contig, r.s, r.e, r.rid
    FROM (SELECT *, row_number() OVER () AS rid FROM r) r
    JOIN mi ON mi.contig = r.contig AND mi.s < r.e AND mi.e > r.s) GROUP BY v),
sz AS (SELECT v AS micro, sum(e - s) AS size, min(pos0) AS pos0 FROM mi GROUP BY v),
tb AS (
  SELECT sz.*, coalesce(reads, 0) AS reads, sum(coalesce(reads, 0)) OVER (ORDER BY micro) AS upto,
         greatest(1.0, sum(coalesce(reads, 0)) OVER ()::DOUBLE / 4.0) AS per
  FROM sz LEFT JOIN hits USING (micro)),
ed AS (SELECT k, CAST(floor(k * per + 0.5) AS BIGINT) AS edge
       FROM (SELECT max(per) AS per FROM tb), unnest(range(1, 5)) AS t(k)),
tk AS (
  SELECT *, upto - reads AS before,
         (SELECT count(*) FROM ed WHERE CASE WHEN reads = 0 THEN edge < upto - reads ELSE edge <= upto - reads END) AS k0,
         (SELECT min(edge) FROM ed WHERE edge > upto - reads AND edge < upto AND reads > 0) AS cut FROM tb),
pt AS (
  SELECT pos0, size, k0, CASE WHEN cut IS NULL THEN size
    ELSE greatest(1, CAST(floor((cut - before)::DOUBLE / reads * size) AS BIGINT)) END AS head FROM tk),
rngs AS (
  SELECT pos0 AS f, pos0 + head AS t, k0 AS v FROM pt
  UNION ALL SELECT pos0 + head, pos0 + size, k0 + 1 FROM pt WHERE head < size),
pc AS (
  SELECT contig, s + greatest(f, mi.pos0) - mi.pos0 AS s, s + least(t, mi.pos0 + e - s) - mi.pos0 AS e, rngs.v
  FROM mi JOIN rngs ON f < mi.pos0 + e - s AND t > mi.pos0),
{_merged('fin', 'pc', 'contig, v')}
SELECT contig, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", CAST(v AS BIGINT) AS value FROM fin"""

# Odd reads: what each kind of line has to come to, written out. Columns: kind, whether mapped and strictly so,
# duplicate, failed, well formed, MD, qualities, standard bases, CIGAR, sequence.
_ODD = """
od AS (
  SELECT (l_orderkey + l_linenumber) % 18 AS kind, 'chr' || (1 + l_suppkey % 4) AS contig,
         10 + (l_partkey * 37 + l_linenumber * 11) % 2000 AS s, 20 + l_orderkey % 41 AS mapq,
         CASE WHEN l_orderkey % 3 = 0 THEN 'default' WHEN l_orderkey % 2 = 0 THEN 'tumor' ELSE 'normal' END AS sample
  FROM lineitem),
kd(kind, mapped, strict, dup, fail, fits, md, qual, std, cigar, seq) AS (VALUES
  (0, 1, 1, 0, 0, 1, 1, 1, 1, '4M', 'ACGT'), (1, 1, 1, 0, 0, 1, 0, 1, 1, '3M', 'ACG'),
  (2, 1, 1, 0, 0, 1, 1, 0, 1, '3M', 'ACG'), (3, 1, 1, 0, 0, 1, 1, 1, 0, '3M', 'ANG'),
  (4, 1, 1, 0, 0, 1, 0, 1, 1, '2=1X1=', 'ACGT'), (5, 1, 1, 0, 0, 1, 1, 1, 1, '2H1S3M1S', 'TACGT'),
  (6, 1, 1, 0, 0, 1, 1, 1, 1, '2M3N2M', 'ACGT'), (7, 1, 1, 0, 0, 1, 1, 1, 1, '2M1P1I1P1I2M', 'ACTTGT'),
  (8, 1, 1, 0, 0, 1, 1, 1, 0, '4M', 'ACNT'), (9, 1, 1, 0, 0, 1, 1, 0, 0, '4M', NULL),
  (10, 1, 1, 0, 0, 1, 1, 1, 1, '4M', 'ACGT'), (11, 0, 0, 0, 0, 1, 1, 1, 1, '4M', 'ACGT'),
  (12, 0, 0, 0, 0, 1, 0, 1, 1, '*', 'ACGT'), (13, 1, 1, 0, 0, 0, 1, 1, 1, '5M', 'ACGT'),
  (14, 1, 1, 1, 0, 1, 1, 1, 1, '4M', 'TTTT'), (15, 1, 1, 0, 1, 1, 1, 1, 1, '4M', 'GGGG'),
  (16, 1, 1, 0, 0, 1, 1, 1, 1, '2M2D2M', 'ACGT'), (17, 1, 0, 0, 0, 1, 1, 1, 1, '1M', 'C'))"""
# Elements of each kind: offset, kind of element, allele, quality (-1: the mapping quality), reference base.
_ODD_ELEMENTS = f"""{_ODD},
ke(kind, o, element, allele, q, ref_base) AS (VALUES
  (0, 0, 'match', 'A', 40, 'A'), (0, 1, 'match', 'C', 40, 'C'), (0, 2, 'match', 'G', 40, 'G'), (0, 3, 'match', 'T', 40, 'T'),
  (1, 0, 'aligned', 'A', 40, NULL), (1, 1, 'aligned', 'C', 40, NULL), (1, 2, 'aligned', 'G', 40, NULL),
  (2, 0, 'match', 'A', 0, 'A'), (2, 1, 'match', 'C', 0, 'C'), (2, 2, 'match', 'G', 0, 'G'),
  (3, 0, 'match', 'A', 40, 'A'), (3, 1, 'mismatch', 'N', 40, 'C'), (3, 2, 'match', 'G', 40, 'G'),
  (4, 0, 'match', 'A', 40, NULL), (4, 1, 'match', 'C', 40, NULL), (4, 2, 'mismatch', 'G', 40, NULL), (4, 3, 'match', 'T', 40, NULL),
  (5, 0, 'match', 'A', 40, 'A'), (5, 1, 'match', 'C', 40, 'C'), (5, 2, 'match', 'G', 40, 'G'),
  (6, 0, 'match', 'A', 40, 'A'), (6, 1, 'match', 'C', 40, 'C'), (6, 2, 'deletion', '', -1, NULL), (6, 3, 'deletion', '', -1, NULL),
  (6, 4, 'deletion', '', -1, NULL), (6, 5, 'match', 'G', 40, 'G'), (6, 6, 'match', 'T', 40, 'T'),
  (7, 0, 'match', 'A', 40, 'A'), (7, 1, 'insertion', 'CTT', 40, 'C'), (7, 2, 'match', 'G', 40, 'G'), (7, 3, 'match', 'T', 40, 'T'),
  (8, 0, 'match', 'A', 40, 'A'), (8, 1, 'match', 'C', 40, 'C'), (8, 2, 'match', 'N', 40, 'N'), (8, 3, 'match', 'T', 40, 'T'),
  (10, 0, 'aligned', 'A', 40, NULL), (10, 1, 'aligned', 'C', 40, NULL), (10, 2, 'aligned', 'G', 40, NULL), (10, 3, 'aligned', 'T', 40, NULL),
  (16, 0, 'match', 'A', 40, 'A'), (16, 1, 'match', 'C', 40, 'C'), (16, 2, 'deletion', '', -1, 'G'), (16, 3, 'deletion', '', -1, 'G'),
  (16, 4, 'match', 'G', 40, 'G'), (16, 5, 'match', 'T', 40, 'T'), (17, 0, 'match', 'C', 40, 'C')),
oe AS (
  SELECT contig, CASE WHEN kind = 17 THEN -1 ELSE s + o END AS locus, sample, element, allele,
         CASE WHEN q < 0 THEN mapq ELSE q END AS q, ref_base
  FROM od JOIN ke USING (kind))"""
_HEADER = """
hd AS (SELECT 'chr' || (c_nationkey % 4 + 1) AS contig, 1000 + count(*) AS length FROM customer GROUP BY ALL
       UNION SELECT 'none', 1)"""

_START_END = 'CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end"'

_PAIRED = f"""{ELEMENTS},
pp AS (SELECT contig, locus, token, count(*) AS depth, count(*) FILTER (kind = 'mismatch') AS mm FROM el GROUP BY ALL)
SELECT contig, {_big('locus', 'locus')}, a.depth AS depth_1, a.mm AS mismatches_1, b.depth AS depth_2, b.mm AS mismatches_2
FROM (SELECT * FROM pp WHERE token = 1) a FULL OUTER JOIN (SELECT * FROM pp WHERE token = 2) b USING (contig, locus)"""

ORACLES: dict[str, str] = {
    "scan_filter_reads": f"""{READS}
SELECT contig, sample, count(*) AS n_reads, count(*) FILTER (fwd) AS n_fwd, {_big('sum(mapq)', 'sum_mapq')},
       {_big('sum(span)', 'sum_span')}, {_big('sum(len)', 'sum_bases')}, {_big('min(s)', 'first_start')},
       {_big('max(e)', 'last_end')}, count(*) AS n_well_formed
FROM r WHERE NOT fail_qc GROUP BY contig, sample""",
    "binary_round_trip": f"""{READS}
SELECT contig, {_big('s', 'start')}, CAST(mapq AS INTEGER) AS mapq, is_dup, fail_qc, fwd, sample, count(*) AS n,
       {_big("sum(CASE WHEN shape IN (5, 6, 7) THEN len ELSE span END)", 'sum_bases')},
       {_big("sum(CASE WHEN NOT (shape = 7 AND s < 1) THEN span END)", 'sum_span')}, count(*) AS n_well_formed
FROM all_r GROUP BY ALL""",
    "tumor_normal_load": f"""{READS}
SELECT contig, CAST(token AS INTEGER) AS token, sample, count(*) AS n, {_big('sum(span)', 'sum_span')}, {_big('sum(mapq)', 'sum_mapq')}
FROM r WHERE NOT fail_qc GROUP BY contig, token, sample""",
    "sam_projection": f"""{READS}
SELECT contig, {_big('s', 'start')}, CAST(mapq AS INTEGER) AS mapq, is_dup, fail_qc, fwd, sample, count(*) AS n
FROM all_r GROUP BY ALL""",
    "odd_read_predicates": f"""WITH {_ODD},
al AS (
  SELECT CASE WHEN mapped = 1 THEN 'mapped' ELSE 'unmapped' END AS kind, sample, kd.* EXCLUDE (kind) FROM od JOIN kd USING (kind)
  UNION ALL SELECT 'strict', sample, kd.* EXCLUDE (kind) FROM od JOIN kd USING (kind) WHERE strict = 1)
SELECT kind, cigar, seq, sample, count(*) AS n, {_big('sum(dup)', 'n_dup')}, {_big('sum(fail)', 'n_fail')},
       {_big('sum(md)', 'n_md')}, {_big('sum(qual)', 'n_qual')}, {_big('sum(fits)', 'n_well_formed')}, {_big('sum(std)', 'n_standard')}
FROM al GROUP BY kind, cigar, seq, sample""",
    "odd_alignment_kinds": f"""WITH {_ODD_ELEMENTS}
SELECT contig, {_big('locus', 'locus')}, sample, element AS kind, allele, CAST(q AS INTEGER) AS q, ref_base, count(*) AS n
FROM oe GROUP BY ALL""",
    "element_at_locus": f"""WITH {_ODD_ELEMENTS}
SELECT contig, element AS kind, allele, count(*) AS n FROM oe WHERE locus = 1000 GROUP BY ALL""",
    "contig_dictionary": f"WITH {_HEADER}\nSELECT contig, length FROM hd WHERE contig <> 'none'",
    "loci_selection": f"""WITH {_HEADER}
SELECT contig, CAST(0 AS BIGINT) AS start, {_big('length', '"end"')} FROM hd WHERE contig <> 'none'""",
    "interval_union_on_contig": f"""WITH {_RANGES}, u AS (SELECT *, (v <> 'O')::INT AS o FROM rg WHERE contig = 'chr3'), {_overlaid('m', 'u', 'o')}
SELECT contig, {_START_END}, v AS value FROM m""",
    "contig_variants": f"""{_threshold(8, False)}
SELECT * FROM gt WHERE contig = 'chr2' AND (length(ref) = 1 AND length(alt) = 1 OR length(ref) <> length(alt))""",
    "read_extent": f"""{READS}
SELECT contig, CAST(0 AS BIGINT) AS start, {_big('max(e)', '"end"')} FROM r GROUP BY contig""",
    "cigar_end_unclipped": f"""{READS}
SELECT contig, {_big('s', 'start')}, count(*) AS n, {_big('sum(e)', 'sum_end')},
       {_big('sum(CASE WHEN shape = 7 THEN s - 2 ELSE s END)', 'sum_unclipped_start')},
       {_big('sum(e)', 'sum_unclipped_end')}, {_big('sum(len)', 'sum_read_length')},
       {_big('sum(span)', 'sum_reference_length')}
FROM r GROUP BY contig, s""",
    "md_mismatches": f"""{ELEMENTS}
SELECT contig, {_big('locus', 'locus')}, ref_base AS base, count(*) AS n
FROM el WHERE base <> '' AND base <> ref_base GROUP BY ALL""",
    "reference_from_md": f"""{ELEMENTS}
SELECT contig, {_big('locus', 'locus')}, max(ref_base) AS ref_base, min(ref_base) AS ref_low FROM el GROUP BY ALL""",
    "normalize_contig": f"""{READS}
SELECT CASE contig WHEN 'chr4' THEN 'M' ELSE substr(contig, 4) END AS contig, count(*) AS n FROM r GROUP BY ALL""",
    "standard_bases": f"""{ELEMENTS}
SELECT contig, TRUE AS standard, (SELECT count(*) FROM r WHERE r.contig = x.contig) AS n,
       {_big('''sum(bq) + (SELECT sum(CASE shape WHEN 6 THEN 2 + ok % 40 WHEN 7 THEN 4 ELSE 0 END)
                    FROM r WHERE r.contig = x.contig)''', 'sum_q')},
       {_big('(SELECT sum(len) FROM r WHERE r.contig = x.contig)', 'n_bases')}
FROM (SELECT contig, CASE WHEN base = '' THEN 0 ELSE 2 + (ok * 3 + j * 5) % 40 END AS bq FROM el) x GROUP BY contig""",
    "pileup_allele_counts": f"""{ELEMENTS}
SELECT contig, {_big('locus', 'locus')}, kind IN ('match', 'mismatch') AS is_base, allele, count(*) AS n,
       count(*) FILTER (fwd) AS n_fwd, max(ref_base) AS ref_base
FROM el GROUP BY ALL""",
    "pileup_by_sample": f"""{ELEMENTS}
SELECT contig, {_big('locus', 'locus')}, sample, count(*) AS depth, count(*) FILTER (kind = 'match') AS match,
       count(*) FILTER (kind = 'mismatch') AS mismatch, count(*) FILTER (kind = 'insertion') AS insertion,
       count(*) FILTER (kind = 'deletion') AS deletion, {_big('sum(q)', 'sum_q')}
FROM el GROUP BY ALL""",
    "pileup_by_token": f"""{ELEMENTS}
SELECT contig, {_big('locus', 'locus')}, CAST(token AS INTEGER) AS token, count(*) AS depth FROM el GROUP BY ALL""",
    "alignment_kinds": f"""{ELEMENTS},
cx AS (
  SELECT *, CASE WHEN shape = 5 THEN CASE WHEN j < h THEN 0 WHEN j < h + 2 THEN 1 ELSE 2 END
                 WHEN shape = 6 THEN CASE WHEN j < h THEN 0 ELSE 2 END WHEN shape = 7 THEN 1 ELSE 0 END AS ci,
         CASE WHEN shape = 5 AND j >= h THEN greatest(j - 2, h) WHEN shape = 6 AND j >= h THEN j + 1
              WHEN shape = 7 THEN j + 2 ELSE j END AS rp,
         CASE WHEN shape = 5 AND j >= h + 2 THEN j - h - 2 WHEN shape IN (5, 6) AND j >= h THEN j - h ELSE j END AS ie
  FROM el)
SELECT contig, {_big('locus', 'locus')}, kind, CAST(ci AS INTEGER) AS cigar_idx, count(*) AS n,
       {_big('sum(rp)', 'sum_read_pos')}, {_big('sum(ie)', 'sum_idx')}, CAST(max(q) AS INTEGER) AS max_q,
       count(*) FILTER (length(allele) = 1) AS n_single
FROM cx GROUP BY contig, locus, kind, ci""",
    "pileup_over_loci": f"""{ELEMENTS}, {_TARGETS}, {_merged('m', 'tg')},
lc AS (SELECT contig, unnest(range(s, e)) AS locus FROM m),
dp AS (SELECT contig, locus, count(*) AS depth FROM el GROUP BY ALL)
SELECT contig, {_big('locus', 'locus')}, {_big('coalesce(depth, 0)', 'depth')} FROM lc LEFT JOIN dp USING (contig, locus)""",
    "base_read_counts": f"""{ELEMENTS}, {_BASE_ROWS}
SELECT contig, {_big('locus', 'locus')}, CAST(token AS INTEGER) AS token, base, count(*) AS n
FROM br WHERE coalesce(bq, 20) >= 20 GROUP BY ALL""",
    "unclipped_base_counts": f"""{ELEMENTS}
SELECT contig, {_big('CASE WHEN shape = 7 THEN locus - 2 ELSE locus END', 'locus')},
       CASE WHEN base = '' THEN NULL ELSE base END AS base, count(*) AS n
FROM el GROUP BY ALL""",
    "min_depth_loci": f"""{ELEMENTS}
SELECT contig, {_big('locus', 'locus')}, count(*) AS depth FROM el GROUP BY contig, locus HAVING count(*) >= 200""",
    "depth_sweep": f"""{READS},
ev AS (SELECT contig, s AS p, 1 AS d FROM r UNION ALL SELECT contig, e, -1 FROM r),
st AS (SELECT contig, p, sum(d) AS d FROM ev GROUP BY ALL HAVING sum(d) <> 0),
rn AS (
  SELECT contig, p, sum(d) OVER w AS depth, lead(p) OVER w AS nxt FROM st
  WINDOW w AS (PARTITION BY contig ORDER BY p))
SELECT contig, {_big('p', 'start')}, {_big('nxt', '"end"')}, {_big('depth', 'depth')} FROM rn WHERE depth > 0""",
    "window_reads": f"""{READS}, {_TARGETS}, {_merged('m', 'tg')},
lc AS (SELECT contig, unnest(range(s, e)) AS locus FROM m)
SELECT lc.contig, {_big('locus', 'locus')}, count(*) AS n_reads, {_big('sum(mapq)', 'sum_mapq')}
FROM lc JOIN r ON r.contig = lc.contig AND r.s <= locus + 3 AND r.e - 1 >= locus - 3 GROUP BY lc.contig, locus""",
    "window_totals_wide": f"""{READS}, {_TARGETS}, {_merged('m', 'tg')},
lc AS (SELECT contig, unnest(range(s, e)) AS locus FROM m)
SELECT lc.contig, {_big('locus', 'locus')}, count(*) AS n_reads, {_big('sum(mapq)', 'sum_mapq')},
       CAST(min(mapq) AS INT) AS min_mapq, {_big('max(r.e - r.s)', 'max_span')}
FROM lc JOIN r ON r.contig = lc.contig AND r.s <= locus + 1000 AND r.e - 1 >= locus - 1000 GROUP BY lc.contig, locus""",
    "new_reads": f"""{READS}, {_TARGETS}, {_merged('m', 'tg')},
lc AS (SELECT contig, unnest(range(s, e)) AS locus FROM m),
pv AS (SELECT *, lag(locus) OVER (PARTITION BY contig ORDER BY locus) AS prev FROM lc)
SELECT pv.contig, {_big('locus', 'locus')}, count(*) AS n_new
FROM pv JOIN r ON r.contig = pv.contig AND r.s <= locus + 3 AND r.e - 1 >= locus - 3
WHERE prev IS NULL OR NOT (r.s <= prev + 3 AND r.e - 1 >= prev - 3) GROUP BY pv.contig, locus""",
    "paired_pileups": _PAIRED,
    "stored_paired_pileups": _PAIRED,
    "stored_reads": f"""{READS},
st AS (SELECT *, unnest(range(s // 64, (greatest(e, s + 1) - 1) // 64 + 1)) AS stretch FROM r)
SELECT contig, {_big('stretch', 'stretch')}, count(*) AS n_rows, count(*) FILTER (stretch = s // 64) AS n_reads,
       {_big('min(s)', 'first_start')}, {_big('max(e)', 'last_end')} FROM st GROUP BY contig, stretch""",
    "top_bases": f"""{ELEMENTS}, {_BASE_ROWS}, {_TOP}
SELECT contig, {_big('locus', 'locus')}, CAST(token AS INTEGER) AS token, base, n, {_big('depth', 'depth')},
       CAST(rk AS INTEGER) AS rank FROM tb""",
    "allele_percents": f"""{ELEMENTS},
dp AS (SELECT contig, locus, sample, count(*) AS depth FROM el GROUP BY ALL),
ct AS (SELECT contig, locus, sample, allele, count(*) AS n FROM el WHERE kind IN ('match', 'mismatch') GROUP BY ALL)
SELECT contig, {_big('locus', 'locus')}, sample, allele, n, depth, round(n * 100.0::DOUBLE / depth, 6) AS percent
FROM ct JOIN dp USING (contig, locus, sample)""",
    "grouped_alleles_top2": f"""{ELEMENTS},
ct AS (SELECT contig, locus, sample, allele, count(*) AS n FROM el WHERE kind IN ('match', 'mismatch') GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY contig, locus, sample ORDER BY n DESC, allele) AS rank FROM ct)
SELECT contig, {_big('locus', 'locus')}, sample, allele, n, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 2""",
    "map_quality_filter": _kept(element="mapq > 30"),
    "region_complexity": _kept("share <= 25"),
    "ambiguous_filter": _kept("low > 0"),
    "multiallelic_filter": _kept("alleles <= 2"),
    "pileup_filter_chain": _kept("alleles <= 4 AND share25 <= 30", "mapq > 25"),
    "genotype_filters": f"""{_threshold(8, False)}
SELECT * FROM gt WHERE read_depth > 20 AND alt_read_depth > 10
  AND (fwd_reads * 100.0 / read_depth BETWEEN 55 AND 75 OR alt_read_depth >= 40)""",
    "threshold_calls": f"{_threshold(8, False)}\nSELECT * FROM gt",
    "threshold_calls_on_loci": f"""{_threshold(8, True)}, {_TARGETS}
SELECT * FROM gt WHERE alleles <> 'NoCall/NoCall'
  AND EXISTS (SELECT 1 FROM tg WHERE tg.contig = gt.contig AND gt.pos >= tg.s AND gt.pos < tg.e)""",
    "threshold_calls_all": f"{_threshold(90, True)}\nSELECT * FROM gt",
    "somatic_threshold_calls": _SOMATIC_THRESHOLD,
    "somatic_calls": f"""{ELEMENTS.replace("THEN 1 ELSE 2 END AS token", "AND l_orderkey % 3 = 0 THEN 1 ELSE 2 END AS token")},
{_BASE_ROWS}, {_TOP},
best AS (SELECT * FROM ranked WHERE token = 1 AND rk = 1),
nd AS (SELECT DISTINCT contig, locus, depth FROM ranked WHERE token = 2),
rf AS (SELECT contig, locus, max(ref_base) AS ref FROM el GROUP BY ALL),
fd AS (SELECT contig, locus, count(*) FILTER (fwd) AS n_fwd FROM br WHERE token = 1 AND coalesce(bq, 20) >= 20 GROUP BY ALL)
SELECT contig, {_big('locus', 'pos')}, ref, base AS alt, 'sample' AS sample, 'Alt/Alt' AS alleles,
       CAST(best.depth AS INTEGER) AS read_depth, CAST(n AS INTEGER) AS alt_read_depth, CAST(n_fwd AS INTEGER) AS fwd_reads
FROM best JOIN nd USING (contig, locus) JOIN rf USING (contig, locus) JOIN fd USING (contig, locus)
WHERE best.depth >= 10 AND nd.depth >= 10 AND base IS NOT NULL AND base <> ref
  AND NOT EXISTS (SELECT 1 FROM tb WHERE tb.token = 2 AND tb.contig = best.contig
                  AND tb.locus = best.locus AND tb.base = best.base)""",
    "bayes_likelihoods": f"""{_bayes()}
SELECT contig, {_big('locus', 'locus')}, sample, a1, a2, {_big('depth', 'depth')},
       round(units / {_LOG}::DOUBLE - depth, 6) AS log_likelihood,
       round(exp((units / {_LOG}::DOUBLE - depth) + depth - depth * ln(2.0::DOUBLE)) * 1e6, 2) AS likelihood_ppm
FROM pairs""",
    "bayes_calls": f"{_bayes()}\nSELECT * FROM gt",
    "bayes_calls_filtered": f"{_bayes('mapq > 25', emit_ref=True, extra=_FILTERED)}\nSELECT * FROM gt",
    "bayes_calls_prior": f"""{_bayes(prior="CASE WHEN a1 = '' AND length(a2) < 2 THEN -400000000000 ELSE 0 END")}
SELECT * FROM gt""",
    "genotype_classes": f"""{_bayes()}
SELECT contig, {_big('locus', 'locus')}, sample, a1, a2, alleles, {_big('len(list_distinct([a1, a2]))', 'n_unique')},
       {_big('(a1 <> ref)::INT + (a2 <> ref)::INT', 'n_variants')}, CAST(2 AS BIGINT) AS ploidy
FROM calls0""",
    "concordance_table": f"""{_bayes()}, {_TRUTH}, {_matched("sample = 'normal'")}
SELECT called, truth, variants FROM mt""",
    "concordance_scores": f"""{_threshold(8, False)}, {_TRUTH}, {_matched("sample = 'tumor'")}, {_SCORES}""",
    "call_filter_write_evaluate": f"""{_bayes()}, {_TRUTH},
{_matched("sample = 'normal' AND read_depth > 20 AND alt_read_depth > 10")}, {_SCORES}""",
    "normalized_deletions": f"""WITH v AS (
  SELECT 1 + l_suppkey % 4 AS c, (l_partkey * 37 + l_linenumber * 11) % 1900 + 20 AS p0, 1 + l_linenumber % 3 AS m,
         count(*) AS n FROM lineitem GROUP BY ALL),
j AS (SELECT *, unnest(range(0, p0)) AS q FROM v),
k AS (SELECT c, p0, m, n, max(q) FILTER ({_letter('q', 0)} <> {_letter('(q + m)', 0)}) + 1 AS p FROM j GROUP BY c, p0, m, n)
SELECT 'chr' || c AS contig, CAST(p AS BIGINT) AS pos,
       substr({_letter('p', 0)} || {_letter('(p + 1)', 0)} || {_letter('(p + 2)', 0)}, 1, CAST(m AS INT)) AS ref, '' AS alt, {_big('sum(n)', 'n')}
FROM k GROUP BY ALL""",
    "tetraploid_genotypes": f"""{ELEMENTS},
s AS (
  SELECT contig, locus, sample, allele, count(*) AS n, max(ref_base) AS ref, count(*) FILTER (q <= 0) AS zero,
         {', '.join(f"sum({_log_copies(k, 4)}) AS s{k}" for k in range(5))}
  FROM el WHERE mapq > 30 GROUP BY ALL),
l AS (SELECT contig, locus, sample, sum(s0) AS base, sum(n) AS depth, max(ref) AS ref FROM s GROUP BY ALL),
a AS (SELECT contig, locus, sample, allele, s.zero, s1 - s0 AS g1, s2 - s0 AS g2, s3 - s0 AS g3, s4 - s0 AS g4 FROM s),
g AS (
  SELECT x.contig, x.locus, x.sample, [x.allele, y.allele, z.allele, w.allele] AS genotype,
         CASE WHEN y.allele = x.allele AND z.allele = x.allele AND w.allele = x.allele THEN x.g4
              WHEN y.allele = x.allele AND z.allele = x.allele THEN x.g3 + w.g1
              WHEN y.allele = x.allele THEN x.g2 + CASE WHEN z.allele = w.allele THEN z.g2 ELSE z.g1 + w.g1 END
              ELSE x.g1 + CASE WHEN y.allele = z.allele AND z.allele = w.allele THEN y.g3
                               WHEN y.allele = z.allele THEN y.g2 + w.g1
                               WHEN z.allele = w.allele THEN y.g1 + z.g2 ELSE y.g1 + z.g1 + w.g1 END END AS gain
  FROM a x JOIN a y ON y.contig = x.contig AND y.locus = x.locus AND y.sample = x.sample AND y.allele >= x.allele
  JOIN a z ON z.contig = x.contig AND z.locus = x.locus AND z.sample = x.sample AND z.allele >= y.allele
  JOIN a w ON w.contig = x.contig AND w.locus = x.locus AND w.sample = x.sample AND w.allele >= z.allele),
bst AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY contig, locus, sample ORDER BY gain DESC, genotype) = 1),
o AS (SELECT bst.*, base, depth, ref, list_filter(genotype, lambda t: t <> ref)[1] AS alt FROM bst JOIN l USING (contig, locus, sample))
SELECT contig, {_big('locus', 'locus')}, sample, array_to_string(genotype, '/') AS genotype, {_big('depth', 'depth')},
       round((base + gain) / {_LOG}::DOUBLE - depth * ln(4.0::DOUBLE), 6) AS log_likelihood,
       array_to_string(list_sort(list_transform(genotype, lambda t: CASE WHEN t = ref THEN '0Ref' WHEN t = alt THEN '1Alt' ELSE '2OtherAlt' END)), '/')
         .regexp_replace('[0-9]', '', 'g') AS calls
FROM o""",
    "variant_types": f"""{_bayes()}
SELECT contig, CASE WHEN length(alt) > length(ref) THEN 'INS' ELSE 'DEL' END AS type, count(*) AS n
FROM gt WHERE length(alt) <> length(ref) GROUP BY ALL""",
    "parquet_genotypes": f"{_threshold(8, False)}\nSELECT * FROM gt",
    "vcf_round_trip": f"{_bayes(emit_ref=True)}\nSELECT * FROM gt",
    "first_genotypes": f"""{_threshold(8, False)}
SELECT * FROM gt ORDER BY contig, pos, ref, alt, sample LIMIT 25""",
    "reference_bases": f"""{READS},
tl AS (SELECT contig, CAST(substr(contig, 4) AS BIGINT) AS c, unnest(range(0, max(e))) AS p FROM r GROUP BY contig)
SELECT contig, {_big('p', 'locus')}, {_letter('p', 0)} AS base FROM tl""",
    "indexed_reference": f"""{READS}, {_TARGETS},
ex AS (SELECT contig, max(e) AS extent FROM r GROUP BY contig),
tp AS (SELECT DISTINCT contig, CAST(substr(contig, 4) AS BIGINT) AS c, unnest(range(s, e)) AS p FROM tg)
SELECT contig, {_big('p', 'locus')}, {_letter('p', 0)} AS base FROM tp JOIN ex USING (contig) WHERE p < extent""",
    "reference_at_reads": f"""{READS}
SELECT contig, {_big('s', 'locus')}, {_letter('s', 0)} AS ref, count(*) AS n FROM r GROUP BY ALL""",
    "interval_merge": f"WITH {_RANGES}, {_merged('m', 'rg')}\nSELECT contig, {_START_END} FROM m",
    "interval_union": f"""WITH {_RANGES}, {_merged('m', 'rg')}
SELECT contig, {_START_END} FROM m""",
    "interval_overlay": f"WITH {_RANGES}, {_overlaid('m', 'rg')}\nSELECT contig, {_START_END}, v AS value FROM m",
    "interval_overlay_wide": f"WITH {_WIDE}, {_overlaid_wide('m', 'rg')}\nSELECT contig, {_START_END}, v AS value FROM m",
    "interval_put_wide": f"""WITH {_WIDE}, lo AS (SELECT * FROM rg WHERE v <> 'P'), hi AS (SELECT * FROM rg WHERE v = 'P'),
{_overlaid_wide('base', 'lo')}, {_merged('top', 'hi')},
u AS (SELECT contig, s, e, v, 0 AS o FROM base UNION ALL SELECT contig, s, e, 'late', 1 FROM top),
{_overlaid_wide('m', 'u', 'o')}
SELECT contig, {_START_END}, v AS value FROM m""",
    "lookup_wide": f"""WITH {_WIDE}, {_overlaid_wide('m', 'rg')}, {_merged('f', 'rg')}
SELECT p.contig, v AS value, count(*) AS n_points FROM pt p JOIN m ON m.contig = p.contig AND m.s <= locus AND m.e > locus
GROUP BY ALL
UNION ALL
SELECT p.contig, 'any', count(*) FROM pt p
WHERE EXISTS (SELECT 1 FROM f WHERE f.contig = p.contig AND f.s < locus + 50 AND f.e > locus) GROUP BY p.contig""",
    "interval_union_maps": f"""WITH {_RANGES}, u AS (SELECT *, (v = 'F')::INT AS o FROM rg), {_overlaid('m', 'u', 'o')}
SELECT contig, {_START_END}, v AS value FROM m""",
    "interval_put": f"""WITH {_RANGES}, lo AS (SELECT * FROM rg WHERE v <> 'P'), hi AS (SELECT * FROM rg WHERE v = 'P'),
{_overlaid('base', 'lo')}, {_merged('top', 'hi')},
u AS (SELECT contig, s, e, v, 0 AS o FROM base UNION ALL SELECT contig, s, e, 'late', 1 FROM top),
{_overlaid('m', 'u', 'o')}
SELECT contig, {_START_END}, v AS value FROM m""",
    "interval_invert": f"""WITH {_RANGES}, {_merged('m', 'rg', 'v, contig')}
SELECT v AS value, contig, {_START_END} FROM m""",
    "interval_stats": f"""WITH {_RANGES}, {_merged('m', 'rg', 'contig, v')}
SELECT v AS value, {_big('sum(e - s)', 'loci')}, count(*) AS ranges, count(DISTINCT contig) AS contigs FROM m GROUP BY v""",
    "interval_contigs": f"WITH {_RANGES}\nSELECT DISTINCT contig FROM rg",
    "interval_take": f"""WITH {_RANGES}, {_merged('m', 'rg')},
o AS (SELECT *, sum(e - s) OVER (ORDER BY contig, s) - (e - s) AS off FROM m),
k AS (SELECT *, s + least(greatest(5000 - off, 0), e - s) AS cut FROM o)
SELECT contig, {_big('s', 'start')}, {_big('cut', '"end"')}, 'first' AS part FROM k WHERE cut > s
UNION ALL SELECT contig, {_big('cut', 'start')}, {_big('e', '"end"')}, 'rest' FROM k WHERE e > cut""",
    "interval_lookup": f"""{READS}, {_TARGETS}, {_overlaid('m', 'tg')}
SELECT r.contig, CAST(v AS INTEGER) AS value, sample, count(*) AS n
FROM r JOIN m ON m.contig = r.contig AND r.s >= m.s AND r.s < m.e GROUP BY ALL""",
    "interval_values_in_range": f"""{READS}, {_TARGETS}, {_overlaid('m', 'tg')},
d AS (SELECT DISTINCT r.contig, r.s, r.e, v FROM r JOIN m ON m.contig = r.contig AND m.s < r.e AND m.e > r.s)
SELECT contig, {_START_END}, count(*) AS n_values, {_big('sum(v)', 'sum_values')} FROM d GROUP BY contig, s, e""",
    "interval_intersects": f"""WITH {_RANGES}, {_merged('m', 'rg')}
SELECT contig, {_START_END} FROM m WHERE s < 60000 AND e > 50000""",
    "interval_on_contig": f"""WITH {_RANGES}, {_overlaid('m', 'rg')}
SELECT contig, {_START_END}, v AS value FROM m WHERE contig = 'chr2'""",
    "interval_loci": f"""WITH {_TARGETS}
SELECT DISTINCT contig, {_big('p', 'locus')} FROM (SELECT contig, unnest(range(s, e)) AS p FROM tg)""",
    "interval_difference": f"""WITH {_RANGES}, n AS (SELECT * FROM rg WHERE v <> 'P'), {_merged('a', 'rg')}, {_merged('b', 'n')}
SELECT contig, {_START_END}, 'left' AS side FROM a WHERE (contig, s, e) NOT IN (SELECT (contig, s, e) FROM b)
UNION ALL
SELECT contig, {_START_END}, 'right' FROM b WHERE (contig, s, e) NOT IN (SELECT (contig, s, e) FROM a)""",
    "interval_spec": f"""WITH {_RANGES}
SELECT contig, {_START_END}, v AS value, count(*) AS n FROM rg GROUP BY contig, s, e, v""",
    "interval_display": f"""WITH {_RANGES}, {_overlaid('m', 'rg')},
t AS (SELECT contig, s, contig || ':' || s || '-' || e || '=' || v AS piece FROM m),
c AS (
  SELECT *, 500 - coalesce(sum(length(piece) + 1) OVER (ORDER BY contig, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM t)
SELECT string_agg(piece, ',' ORDER BY contig, s) FILTER (room > 6)
       || CASE WHEN count(*) FILTER (room <= 6) > 0 THEN ', [...]' ELSE '' END AS text FROM c""",
    "overlap_join": f"""{READS}, {_TARGETS}, {_overlaid('m', 'tg')},
x AS (SELECT *, row_number() OVER () AS rid FROM r),
d AS (SELECT DISTINCT rid, x.contig, v, sample, mapq FROM x JOIN m ON m.contig = x.contig AND m.s < x.e + 3 AND m.e > greatest(x.s - 3, 0))
SELECT contig, CAST(v AS INTEGER) AS value, sample, count(*) AS n, {_big('sum(mapq)', 'sum_mapq')} FROM d GROUP BY contig, v, sample""",
    "overlap_pairs": f"""{READS}, {_TARGETS}, {_merged('m', 'tg')}
SELECT r.contig, {_big('m.s', 'range_start')}, {_big('m.e', 'range_end')}, count(*) AS n
FROM r JOIN m ON m.contig = r.contig AND m.s < r.e AND m.e > r.s GROUP BY ALL""",
    "overlap_semi": f"""{READS}, {_TARGETS}
SELECT contig, sample, count(*) AS n, {_big('sum(s)', 'sum_start')}, {_big('sum(mapq)', 'sum_mapq')}
FROM r WHERE EXISTS (SELECT 1 FROM tg WHERE tg.contig = r.contig AND tg.s < r.e + 3 AND tg.e > greatest(r.s - 3, 0))
GROUP BY contig, sample""",
    "reads_at_locus": f"""{READS}
SELECT contig, sample, count(*) AS n, {_big('sum(s)', 'sum_start')} FROM r
WHERE s - 3 <= 1000 AND e + 3 > 1000 GROUP BY contig, sample""",
    "uniform_split": f"""WITH {_RANGES}, {_merged('m', 'rg')}, {_even('sp', 'm', '7')}
SELECT contig, {_START_END}, CAST(v AS BIGINT) AS value FROM sp""",
    "balanced_split": _BALANCED,
    "reads_by_bucket": f"""{READS}, {_CONTIG_LOCI}, {_even('sp', 'cl', '7')},
x AS (SELECT *, row_number() OVER () AS rid FROM r),
d AS (SELECT DISTINCT rid, x.contig, x.token, x.s, x.e, v FROM x JOIN sp ON sp.contig = x.contig AND sp.s < x.e AND sp.e > x.s)
SELECT CAST(v AS BIGINT) AS value, contig, CAST(token AS INTEGER) AS token, count(*) AS n, {_big('min(s)', 'first_start')},
       {_big('max(e)', 'last_end')} FROM d GROUP BY v, contig, token""",
    "skew_report": f"""{READS}, {_CONTIG_LOCI}, {_even('sp', 'cl', '7')},
x AS (SELECT *, row_number() OVER () AS rid FROM r),
d AS (SELECT DISTINCT rid, v FROM x JOIN sp ON sp.contig = x.contig AND sp.s < x.e AND sp.e > x.s),
n AS (SELECT v, count(*)::DOUBLE AS reads FROM d GROUP BY v)
SELECT round(min(reads), 6) AS "min", round(quantile_cont(reads, 0.25), 6) AS p25, round(median(reads), 6) AS median,
       round(avg(reads), 6) AS mean, round(quantile_cont(reads, 0.75), 6) AS p75, round(max(reads), 6) AS "max",
       round((max(reads) - avg(reads)) * 100.0 / avg(reads), 6) AS max_over_mean_percent FROM n""",
    "bucket_report": f"""{READS}, {_CONTIG_LOCI}, {_even('sp', 'cl', '50')},
x AS (SELECT *, row_number() OVER () AS rid FROM r),
d AS (SELECT DISTINCT rid, v FROM x JOIN sp ON sp.contig = x.contig AND sp.s < x.e AND sp.e > x.s),
n AS (SELECT v, count(*) AS reads FROM d GROUP BY v)
SELECT min(reads) AS "min", round(avg(reads), 6) AS mean, max(reads) AS "max" FROM n""",
    "scan_counters": f"""{READS}, {_TARGETS}, {_merged('m', 'tg')}, {_even('sp', 'm', '7')},
x AS (SELECT *, row_number() OVER () AS rid FROM r),
d AS (SELECT DISTINCT rid, v FROM x JOIN sp ON sp.contig = x.contig AND sp.s < x.e AND sp.e > x.s),
n AS (SELECT (SELECT count(*) FROM r) AS total, count(DISTINCT rid) AS relevant, count(*) AS expanded FROM d)
SELECT total, relevant, expanded, round((expanded - relevant) * 100.0::DOUBLE / relevant, 6) AS expansion_percent FROM n""",
}
