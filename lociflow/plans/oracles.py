"""DuckDB SQL that gives the rows of each query."""

from __future__ import annotations

#: The alignment of ``alignment``, from the standard tables.
TABLES = r"""
WITH RECURSIVE dims AS (SELECT CAST(8*count(*) AS INT) AS len FROM part),
syn_ref AS (
  SELECT c.contig, CAST(p_partkey/4 AS INT) AS block, translate(md5(c.contig || ':' || CAST(CAST(p_partkey/4 AS INT) AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq
  FROM part, (VALUES ('chr1'), ('chr2')) c(contig) WHERE p_partkey % 4 = 0),
pairs AS (SELECT a.contig, a.block, a.seq || b.seq AS both_seq FROM syn_ref a JOIN syn_ref b ON a.contig = b.contig AND b.block = a.block + 1),
r0 AS (
  SELECT 'chr' || CAST(l_orderkey % 2 + 1 AS STRING) AS contig, CAST((l_partkey*37 + l_linenumber*101 + l_suppkey*13 + l_orderkey*7) % (len-64) AS INT) AS ref_start,
         CAST(l_quantity AS INT) AS mapq, CAST(l_quantity AS INT) % 5 AS k, CAST(6+l_linenumber AS INT) AS j, l_suppkey % 3 AS rot, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem, dims),
r1 AS (SELECT r0.*, substr(both_seq, ref_start % 32 + 1, 32) AS t FROM r0 JOIN pairs p ON p.contig = r0.contig AND p.block = CAST(floor(ref_start/32) AS INT)),
r2 AS (
  SELECT *, CASE k WHEN 0 THEN '30M' WHEN 1 THEN '4S10M2I16M' WHEN 2 THEN '12M3D17M' WHEN 3 THEN '10M1I5M2N13M' ELSE '2H30M' END AS cigar,
         CASE k WHEN 1 THEN 'NNNN' || substr(t,1,10) || 'GT' || substr(t,11,16) WHEN 2 THEN substr(t,1,12) || substr(t,16,17)
                WHEN 3 THEN substr(t,1,10) || 'A' || substr(t,11,5) || substr(t,18,13) ELSE substr(t,1,30) END AS q FROM r1),
syn_reads AS (
  SELECT CAST(row_number() OVER (ORDER BY contig, ref_start, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS read_ord,
         'r' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS read_name, contig, ref_start, mapq, cigar,
         substr(q,1,j) || translate(substr(q,j+1,1),'ACGT', CASE rot WHEN 0 THEN 'CGTA' WHEN 1 THEN 'GTAC' ELSE 'TACG' END) || substr(q,j+2) AS seq,
         ref_start + CASE k WHEN 0 THEN 30 WHEN 1 THEN 26 WHEN 2 THEN 32 WHEN 3 THEN 30 ELSE 30 END AS ref_end
  FROM r2),
v0 AS (
  SELECT o_orderkey, o_custkey, o_orderpriority, 'chr' || CAST(o_orderkey % 2 + 1 AS STRING) AS contig, CAST((o_orderkey*11 + o_custkey) % (len-64) AS INT) AS p0, o_orderkey % 6 AS k FROM orders, dims),
v1 AS (SELECT v0.*, substr(both_seq, p0 % 32 + 1, 4) AS t FROM v0 JOIN pairs p ON p.contig = v0.contig AND p.block = CAST(floor(p0/32) AS INT)),
syn_variants AS (
  SELECT CAST(row_number() OVER (ORDER BY contig, p0, o_orderkey) AS BIGINT) AS rec_ord, contig, p0 + 1 AS pos,
         CASE k WHEN 2 THEN substr(t,1,4) WHEN 4 THEN substr(t,1,2) ELSE substr(t,1,1) END AS ref,
         CASE k WHEN 1 THEN substr(t,1,1) || 'GT' WHEN 2 THEN substr(t,1,1) WHEN 3 THEN translate(substr(t,1,1),'ACGT','CGTA') || ',' || translate(substr(t,1,1),'ACGT','GTAC')
                WHEN 4 THEN substr(t,1,2) || 'T,' || substr(t,1,1) ELSE translate(substr(t,1,1),'ACGT','TACG') END AS alt,
         CASE o_custkey % 5 WHEN 0 THEN '0/1' WHEN 1 THEN '1/1' WHEN 2 THEN '0/0' WHEN 3 THEN './.' ELSE '1' END AS gt,
         CASE WHEN substr(o_orderpriority,1,1) = '1' THEN 'q10' ELSE 'PASS' END AS filter
  FROM v1)"""

#: CIGAR operations with their offsets.
OPS = (
    TABLES
    + r""",
ops0 AS (SELECT read_ord, read_name, contig, ref_start, mapq, seq, regexp_extract_all(cigar, '\d+[MIDNSHP]') AS parts FROM syn_reads),
ops1 AS (SELECT * EXCLUDE (parts), unnest(parts) AS part, (generate_subscripts(parts, 1) - 1)::INT AS op_idx FROM ops0),
ops2 AS (SELECT * EXCLUDE (part), right(part, 1) AS op, left(part, length(part) - 1)::INT AS n FROM ops1),
ops AS (SELECT *, coalesce(sum(CASE WHEN op IN ('M','D','N') THEN n ELSE 0 END) OVER w, 0)::BIGINT AS rp, coalesce(sum(CASE WHEN op IN ('M','I','S') THEN n ELSE 0 END) OVER w, 0)::BIGINT AS qp
        FROM ops2 WINDOW w AS (PARTITION BY read_ord ORDER BY op_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
)

#: Events of well mapped reads.
EVENTS = (
    OPS
    + r""",
ev0 AS (SELECT *, unnest(CASE WHEN op = 'I' THEN [-1::BIGINT] ELSE range(n) END) AS k FROM ops WHERE op IN ('M','D','N','I') AND mapq > 5),
ev1 AS (SELECT contig, (ref_start + rp + k)::INT AS pos, read_ord, op_idx, read_name, op, (op = 'I')::INT AS cls,
               CASE op WHEN 'M' THEN substr(seq, (qp + k + 1)::INT, 1) WHEN 'I' THEN substr(seq, (qp + 1)::INT, n) ELSE '*' END AS allele FROM ev0),
ev2 AS (SELECT e.*, substr(f.seq, pos % 32 + 1, 1) AS ref_base FROM ev1 e JOIN syn_ref f ON f.contig = e.contig AND f.block = pos // 32),
ev AS MATERIALIZED (SELECT *, (op <> 'I')::INT AS cov, (op <> 'M' OR allele <> ref_base)::INT AS mm, (op = 'I' OR op = 'M' AND allele <> ref_base)::INT AS edit FROM ev2)"""
)

RUNNING = (
    EVENTS
    + r""",
counted AS (SELECT contig, pos, mm, sum(cov) OVER w AS rc, sum(mm) OVER w AS rm FROM ev WINDOW w AS (PARTITION BY contig, pos ORDER BY read_ord, op_idx ROWS UNBOUNDED PRECEDING)),
cand AS (SELECT DISTINCT contig, pos FROM counted WHERE mm = 1 AND rm > 2 AND rc > 10 AND floor(rm * 100 / rc) > 2)"""
)


def ranked(order: str = "ASC") -> str:
    return (
        RUNNING
        + f""",
hist AS (SELECT contig, pos, any_value(ref_base) AS ref_base, cls, allele, count(*) AS freq, min(read_ord * 64 + op_idx) AS seen FROM ev WHERE mm = 1 GROUP BY contig, pos, cls, allele),
alleles AS (SELECT contig, pos, ref_base, cls, allele, freq, (row_number() OVER (PARTITION BY contig, pos, cls ORDER BY freq {order}, seen))::INT AS rnk
            FROM hist SEMI JOIN cand USING (contig, pos) QUALIFY rnk <= 2)"""
    )


def truth(hom_filter: bool = True, mutation: bool = True, start: str = TABLES) -> str:
    called = "AND NOT (gt = '0/0')" if hom_filter else ""
    vref = "CASE WHEN length(ref) > 1 AND len(list_filter(alts[1:alt_idx], lambda a: length(a) > length(ref))) > 0 THEN left(ref, 1) ELSE ref END" if mutation else "ref"
    return (
        start
        + f""",
t0 AS (SELECT rec_ord, contig, pos, ref, split(alt, ',') AS alts, CASE gt WHEN '0/0' THEN 0 WHEN '0/1' THEN 1 ELSE 2 END AS gt FROM syn_variants WHERE filter = 'PASS' {called}),
t1 AS (SELECT *, unnest(alts) AS alt, (generate_subscripts(alts, 1) - 1)::INT AS alt_idx FROM t0),
t2 AS (SELECT * REPLACE ({vref} AS ref) FROM t1),
truth AS (
  SELECT contig, pos - 1 AS vpos, 0 AS cls, ref AS vref, alt AS valt, gt, rec_ord, alt_idx, 0 AS i FROM t2 WHERE length(ref) = 1 AND length(alt) = 1
  UNION ALL SELECT contig, pos - 1, 1, left(ref, 1), left(alt, length(alt) - length(ref) + 1), gt, rec_ord, alt_idx, 0 FROM t2 WHERE length(ref) < length(alt)
  UNION ALL SELECT contig, (pos + i - 1)::INT, 0, substr(ref, (i + 1)::INT, 1), '*', gt, rec_ord, alt_idx, i::INT FROM (SELECT *, unnest(range(length(alt), length(ref))) AS i FROM t2 WHERE length(ref) > length(alt)))"""
    )


def labelled(span: int = 2, start: str | None = None) -> str:
    return (
        truth(start=start or ranked())
        + f""",
spoken AS (SELECT contig, unnest(range(vpos - {span - 1}, vpos + 1)) AS pos, cls, valt, gt, ((vpos::HUGEINT * 1000000 + rec_ord) * 100 + alt_idx) * 100 + i AS nth FROM truth),
last_said AS (SELECT contig, pos, cls, valt, arg_max(gt, nth) AS gt FROM spoken GROUP BY contig, pos, cls, valt),
lab AS (SELECT a.*, coalesce(m.gt, 0) AS gt FROM alleles a LEFT JOIN last_said m ON m.contig = a.contig AND m.pos = a.pos AND m.cls = a.cls AND m.valt = CASE a.cls WHEN 1 THEN a.ref_base || a.allele ELSE a.allele END)"""
    )


ROWS = " SELECT contig, pos AS start, pos + 1 AS stop, ref_base AS ref, allele, gt FROM lab"
LENGTHS = ", lengths AS (SELECT contig, max(block::BIGINT * 32 + length(seq)) AS length FROM syn_ref GROUP BY contig)"
CHUNKS = LENGTHS + ", chunks AS (SELECT contig, c::INT AS chunk_id, (c * 500)::INT AS start, least((c + 1) * 500 + 10, length)::INT AS stop FROM (SELECT contig, length, unnest(range(ceil(length / 500)::BIGINT)) AS c FROM lengths))"
BEDS = """
WITH n AS (SELECT 8 * count(*) AS n FROM part),
a AS (SELECT 'chr' || (o_orderkey % 2 + 1)::VARCHAR AS contig, (o_orderkey * 17 % n)::INT AS start, (o_orderkey * 17 % n + 5 + o_custkey % 20)::INT AS stop, o_orderkey AS name FROM orders, n),
b AS (SELECT 'chr' || (p_partkey % 2 + 1)::VARCHAR AS contig, (p_partkey * 29 % n)::INT AS start, (p_partkey * 29 % n + p_size)::INT AS stop FROM part, n)"""


def windows(gap: int, offset: int) -> str:
    return (
        RUNNING
        + f""",
marked AS (SELECT contig, pos, sum(CASE WHEN pos - before <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY pos) AS run FROM (SELECT *, lag(pos) OVER (PARTITION BY contig ORDER BY pos) AS before FROM cand))
SELECT contig, min(pos) - {offset} AS start, max(pos) + {offset} AS stop, count(*) AS n FROM marked GROUP BY contig, run"""
    )


CHUNK_CANDIDATES = (
    EVENTS
    + CHUNKS
    + r""",
placed AS (SELECT c.chunk_id, e.* FROM ev e JOIN syn_reads r USING (read_ord) JOIN chunks c ON c.contig = r.contig AND r.ref_start < c.stop AND r.ref_end > c.start WHERE e.pos BETWEEN c.start AND c.stop),
counted AS (SELECT *, sum(cov) OVER w AS rc, sum(mm) OVER w AS rm FROM placed WINDOW w AS (PARTITION BY chunk_id, contig, pos ORDER BY read_ord, op_idx ROWS UNBOUNDED PRECEDING)),
cand AS (SELECT DISTINCT chunk_id, contig, pos FROM counted WHERE mm = 1 AND rm > 2 AND rc > 10 AND floor(rm * 100 / rc) > 2),
hist AS (SELECT chunk_id, contig, pos, any_value(ref_base) AS ref_base, cls, allele, count(*) AS freq, min(read_ord * 64 + op_idx) AS seen FROM placed WHERE mm = 1 GROUP BY chunk_id, contig, pos, cls, allele),
alleles AS (SELECT chunk_id, contig, pos, ref_base, cls, allele, freq, (row_number() OVER (PARTITION BY chunk_id, contig, pos, cls ORDER BY freq, seen))::INT AS rnk FROM hist SEMI JOIN cand USING (chunk_id, contig, pos) QUALIFY rnk <= 2)"""
)

#: The middle half of a contig.  It has the reads that overlap the half-open range, and positions up to its end, included.
FROM, TO = "(SELECT len // 4 FROM dims)", "(SELECT 3 * len // 4 FROM dims)"
IN_REGION = f"contig = 'chr1' AND ref_start < {TO} AND ref_end > {FROM}"
REGION = labelled().replace("AS parts FROM syn_reads", f"AS parts FROM syn_reads WHERE {IN_REGION}") + ROWS + f" WHERE pos BETWEEN {FROM} AND {TO}"

#: Variants with ALT alleles that are missing, symbolic or a deletion marker, and with several filters.
ODD = "(SELECT * REPLACE (CASE pos % 4 WHEN 0 THEN '.' WHEN 1 THEN '<DEL>' WHEN 2 THEN '*' ELSE alt END AS alt) FROM syn_variants)"

SHOWN = "struct_pack(allele := allele, cls := cls, freq := freq, pos := pos, ref_base := ref_base)"
DOCUMENTS = (
    ranked()
    + CHUNKS
    + f""",
regions AS (SELECT contig, start, least(stop - 10, start + 500) - 1 AS stop FROM chunks),
docs AS (SELECT r.contig, r.start, r.stop, list({SHOWN} ORDER BY a.pos, a.cls, a.rnk) FILTER (a.pos IS NOT NULL) AS found FROM regions r LEFT JOIN alleles a ON a.contig = r.contig AND a.pos BETWEEN r.start AND r.stop GROUP BY ALL)"""
)

SQL: dict[str, str] = {
    "src1_sam_roundtrip": TABLES + " SELECT read_name, contig, ref_start, mapq, 0 AS flag, cigar, seq FROM syn_reads",
    "src1_bam_roundtrip": TABLES + " SELECT read_ord AS read_nth, read_name, contig, ref_start, mapq, 0 AS flag, cigar, seq FROM syn_reads",
    "src1_files_labelled": labelled() + ROWS,
    "src2_bam_region": TABLES + f" SELECT read_name, ref_start, ref_end, cigar FROM syn_reads WHERE {IN_REGION}",
    "src2_region_scan": TABLES + f" SELECT read_ord, read_name, ref_start, ref_end FROM syn_reads WHERE {IN_REGION}",
    "src3_pileup_columns": EVENTS + " SELECT contig, pos, count(*) AS n_reads, string_agg(allele, '' ORDER BY read_ord, op_idx) AS bases FROM ev WHERE cov = 1 GROUP BY contig, pos",
    "src3_filtered_columns": EVENTS + r""",
bases AS (SELECT e.contig, e.pos, e.read_ord, e.op_idx, e.allele, e.op, o.qp + e.pos - o.ref_start - o.rp AS place FROM ev e JOIN ops o ON o.read_ord = e.read_ord AND o.op_idx = e.op_idx WHERE e.cov = 1),
kept AS (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY read_ord, op_idx) AS nth FROM bases WHERE read_ord % 10 <> 0 AND (op <> 'M' OR ascii(substr('+5?I', ((read_ord + place) % 4 + 1)::INT, 1)) - 33 >= 20))
SELECT contig, pos, count(*) AS n_reads, string_agg(allele, '' ORDER BY read_ord, op_idx) AS bases FROM kept WHERE nth <= 20 GROUP BY contig, pos""",
    "src4_fasta_roundtrip": TABLES + ", whole AS (SELECT contig, string_agg(seq, '' ORDER BY block) AS s FROM syn_ref GROUP BY contig) SELECT contig, b::INT AS block, substr(s, (b * 100 + 1)::BIGINT, 100) AS seq FROM (SELECT *, unnest(range(ceil(length(s) / 100)::BIGINT)) AS b FROM whole)",
    "src4_indexed": TABLES + ", whole AS (SELECT contig, string_agg(seq, '' ORDER BY block) AS s FROM syn_ref GROUP BY contig) SELECT contig, b::INT AS block, substr(s, (b * 100 + 1)::BIGINT, 100) AS seq FROM (SELECT *, unnest(range(ceil(length(s) / 100)::BIGINT)) AS b FROM whole)",
    "src4_index": TABLES + " SELECT contig AS name, sum(length(seq))::BIGINT AS length, 32 AS line_bases, 33 AS line_bytes, 0::BIGINT AS broken FROM syn_ref GROUP BY contig",
    "src5_reference_bases": TABLES + " SELECT read_ord, substr(both_seq, ref_start % 32 + 1, ref_end - ref_start) AS bases FROM syn_reads r JOIN pairs p ON p.contig = r.contig AND p.block = ref_start // 32",
    "src6_contig_length": TABLES + LENGTHS + " SELECT contig, length FROM lengths",
    "src7_vcf_roundtrip": TABLES + " SELECT contig, pos, ref, alt, filter, gt FROM syn_variants",
    "src8_records": TABLES + " SELECT rec_ord, contig, pos, ref, alt AS alts, len(split(gt, '/'))::INT AS n_gt, filter, 10.0::DOUBLE AS qual FROM syn_variants WHERE filter = 'PASS' AND gt <> '0/0'",
    "src11_bed_index": BEDS + " SELECT contig, start, stop, (row_number() OVER (PARTITION BY contig ORDER BY start, stop) - 1)::INT AS idx FROM b",
    "src7_indexed_roundtrip": TABLES + " SELECT contig, pos, ref, alt, filter, gt FROM syn_variants",
    "src7_indexed_region": TABLES + f" SELECT contig, pos, ref, alt, gt FROM syn_variants WHERE contig = 'chr1' AND pos - 1 < {TO} AND pos - 1 + length(ref) > {FROM}",
    "src7_region_scan": TABLES + f" SELECT rec_ord, contig, pos, ref FROM syn_variants WHERE contig = 'chr1' AND pos - 1 < {TO} AND pos - 1 + length(ref) > {FROM}",
    "src9_bed_load": BEDS + " SELECT contig, start, stop, name::VARCHAR AS name FROM a",
    "src10_list_to_bed": "SELECT 'chr' || (n_regionkey + 1)::VARCHAR AS contig, (n_nationkey * 100)::INT AS start, (n_nationkey * 100 + length(n_name))::INT AS stop FROM nation",
    "src12_list_files": labelled() + " SELECT contig, 'csv' AS kind, sum(length(concat_ws(chr(9), contig, pos, pos + 1, ref_base, allele, coalesce(gt::VARCHAR, ''))) + 1)::BIGINT AS bytes FROM lab GROUP BY contig",
    "flt10_invalid_reads": TABLES + " SELECT read_ord FROM syn_reads WHERE mapq % 4 = 0",
    "flt10_read_reasons": TABLES + " SELECT CASE mapq % 8 WHEN 3 THEN 'no start' WHEN 1 THEN 'no CIGAR' WHEN 0 THEN 'unknown operation' WHEN 2 THEN 'bases that don''t fit' END AS reason, count(*) AS n FROM syn_reads GROUP BY 1",
    "flt5_record_reasons": TABLES
    + r""",
a0 AS (SELECT *, split(CASE WHEN pos % 4 = 0 THEN repeat('G', length(ref)) ELSE alt END, ',') AS alts FROM syn_variants),
a1 AS (SELECT *, unnest(alts) AS one, generate_subscripts(alts, 1) - 1 AS alt_idx FROM a0),
a2 AS (SELECT *, CASE WHEN length(ref) > 1 AND len(list_filter(alts[1:alt_idx], lambda a: length(a) > length(ref))) > 0 THEN 1 ELSE length(ref) END AS size FROM a1)
SELECT CASE WHEN filter <> 'PASS' THEN 'filter' WHEN gt = '0/0' THEN 'not called' WHEN size = length(one) AND size > 1 THEN 'no class' END AS reason, count(*) AS n FROM a2 GROUP BY 1""",
    "fn4_odd_alts": truth(hom_filter=False).replace("FROM syn_variants", f"FROM {ODD}") + " SELECT * FROM truth",
    "lim1_first_filter": TABLES + " SELECT contig, pos, ref, alt, gt, filter FROM syn_variants",
    "flt1_mapq": TABLES + " SELECT read_ord, read_name, mapq FROM syn_reads WHERE mapq > 5",
    "flt8_supported": labelled() + " SELECT contig, pos, bool_or(gt <> 0) AS supported, coalesce(bool_or(gt <> 0) FILTER (cls = 1), false) AS in_supported, coalesce(bool_or(gt <> 0) FILTER (cls = 0), false) AS snp_supported, count(DISTINCT gt) AS n_genotypes FROM lab GROUP BY contig, pos",
    "flt8_supported_lists": labelled() + " SELECT contig, pos, cls, count(*) AS n, bool_or(gt <> 0) AS supported FROM lab GROUP BY contig, pos, cls",
    "exp1_cigar_ops": OPS + " SELECT read_ord, op_idx, op, n, rp, qp, CASE WHEN op IN ('M', 'I') THEN substr(seq, (qp + 1)::INT, n) ELSE '' END AS bases FROM ops",
    "exp2_mismatch_events": EVENTS + " SELECT contig, pos, read_ord, op_idx, cls, allele, ref_base, cov, edit FROM ev WHERE mm = 1",
    "agg1_pileup": EVENTS + " SELECT contig, pos, sum(cov)::BIGINT AS coverage, sum(mm)::BIGINT AS mismatches, sum(edit)::BIGINT AS edits, CASE WHEN sum(cov) > 0 THEN (sum(mm) * 100 // sum(cov))::BIGINT END AS percent FROM ev GROUP BY contig, pos",
    "agg4_reads_by_position": EVENTS + " SELECT contig, pos, string_agg(read_name, ',' ORDER BY read_ord, op_idx) AS read_names FROM ev WHERE mm = 1 GROUP BY contig, pos",
    "agg5_allele_histogram": EVENTS + " SELECT contig, pos, cls, allele, count(*) AS freq, min(read_ord) AS first_read FROM ev WHERE mm = 1 GROUP BY contig, pos, cls, allele",
    "agg7_covered_reference": EVENTS + " SELECT DISTINCT contig, pos, ref_base FROM ev WHERE cov = 1",
    "agg9_genotype_counts": truth(hom_filter=False) + " SELECT count(*) FILTER (gt = 0) AS hom, count(*) FILTER (gt = 1) AS het, count(*) FILTER (gt = 2) AS hom_alt FROM t2",
    "agg10_position_index": truth() + " SELECT contig, vpos, cls, string_agg(vref || '>' || valt || ':' || gt, ',' ORDER BY rec_ord, alt_idx, i) AS entries FROM truth GROUP BY contig, vpos, cls",
    "agg11_region_json": DOCUMENTS + " SELECT contig, start, stop, to_json(struct_pack(all_candidates := coalesce(found, []), chromosome_name := contig, end_position := stop, start_position := start))::VARCHAR AS document FROM docs",
    "win1_candidates_running": RUNNING + " SELECT contig, pos FROM cand",
    "win1_candidates_final": EVENTS + " SELECT contig, pos FROM ev GROUP BY contig, pos HAVING sum(mm) > 2 AND sum(cov) > 10 AND sum(mm) * 100 // sum(cov) > 2",
    "win3_merge_windows": windows(1, 0),
    "win3_merge_windows_apart": windows(2, 1),
    "topk1_alleles": ranked() + " SELECT * FROM alleles",
    "topk1_alleles_commonest": ranked("DESC") + " SELECT * FROM alleles",
    "prj1_candidate_sites": ranked() + " SELECT contig, pos, any_value(ref_base) AS ref_base, coalesce(string_agg(allele || ':' || freq, ',' ORDER BY rnk) FILTER (cls = 1), '') AS in_alleles, coalesce(string_agg(allele || ':' || freq, ',' ORDER BY rnk) FILTER (cls = 0), '') AS snp_alleles FROM alleles GROUP BY contig, pos",
    "stream1_sessions": """
WITH e AS (SELECT user_id, ts::TIMESTAMP AS ts, value, lag(ts::TIMESTAMP) OVER w AS before FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, count(*) FILTER (before IS NULL OR ts - before > INTERVAL 12 HOUR) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS run FROM e),
s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS stop, count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY user_id, run)
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(stop, '%Y-%m-%d %H:%M:%S.%f') AS stop, n, total FROM s WHERE stop <= (SELECT max(ts::TIMESTAMP) - INTERVAL 1 DAY FROM events)""",
    "stream2_pileup": EVENTS + " SELECT contig, pos, sum(cov)::BIGINT AS coverage, sum(mm)::BIGINT AS mismatches, sum(edit)::BIGINT AS edits, CASE WHEN sum(cov) > 0 THEN (sum(mm) * 100 // sum(cov))::BIGINT END AS percent FROM ev GROUP BY contig, pos",
    "vcf_decompose": truth() + " SELECT * FROM truth",
    "vcf_decompose_unchanged": truth(hom_filter=False, mutation=False) + " SELECT * FROM truth",
    "fn13_record_text": TABLES + " SELECT rec_ord, concat_ws(chr(9), pos, '10', gt, filter, CASE WHEN CASE WHEN gt = '1' THEN true ELSE gt <> '0/0' AND filter = 'PASS' END THEN 'true' ELSE 'false' END, ref || ',' || alt, alt) AS line FROM syn_variants",
    "join1_chunk_overlap": TABLES + CHUNKS + " SELECT r.contig, chunk_id, read_ord, ref_start FROM syn_reads r JOIN chunks c ON c.contig = r.contig AND r.ref_start < c.stop AND r.ref_end > c.start",
    "join3_label": labelled() + ROWS,
    "join3_label_one_position": labelled(1) + ROWS,
    "join3_label_none": ranked() + " SELECT contig, pos AS start, pos + 1 AS stop, ref_base AS ref, allele, 0 AS gt FROM alleles",
    "join5_intersect": BEDS + " SELECT a.contig, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop, name FROM a JOIN b ON a.contig = b.contig AND a.start < b.stop AND b.start < a.stop",
    "par1_chunks": TABLES + CHUNKS + " SELECT * FROM chunks",
    "par2_equal_chunks": TABLES + LENGTHS + " SELECT contig, i::INT AS chunk_id, (i * ceil(length / 5))::INT AS start, ((i + 1) * ceil(length / 5) + 1000)::INT AS stop FROM lengths, range(5) t(i)",
    "par3_chunk_candidates": CHUNK_CANDIDATES + " SELECT * FROM alleles",
    "par5_chunk_labels": labelled(start=CHUNK_CANDIDATES) + " SELECT chunk_id, contig, pos AS start, pos + 1 AS stop, ref_base AS ref, allele, gt FROM lab",
    "par5_region": REGION,
    "sink1_bed_roundtrip": labelled() + ROWS,
    "sink2_json_roundtrip": DOCUMENTS + ", rows AS (SELECT contig, start, stop, unnest(CASE WHEN found IS NULL THEN [NULL] ELSE found END) AS x FROM docs) SELECT contig AS chromosome_name, start AS start_position, stop AS end_position, x.allele AS allele, x.cls AS cls, x.freq AS freq, x.pos AS pos, x.ref_base AS ref_base FROM rows",
}
