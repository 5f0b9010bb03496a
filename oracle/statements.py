"""One statement per registered query. Every column carries the name the Spark query gives it."""

from __future__ import annotations

_POINTS = ("l_points, a_points, c_points, e_points, mod_adherence_point, mod_barrier_point")
_MASK_ROLES = ("ADMIN", "CLINICIAN", "CARE_MGR", "ANALYST")
_CLINICS = {"CLINICIAN": "('AFRICA', 'AMERICA')",
            "CARE_MGR": "('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')"}


def _rows_for(role: str, clinic: str = "attributed_clinic") -> str:
    return f"{clinic} IN {_CLINICS[role]}" if role in _CLINICS else "true"


def _masked_panel() -> str:
    parts = []
    for role in _MASK_ROLES:
        full = role in ("ADMIN", "CLINICIAN")
        name = ("{0}" if full else
                "left({0}, 1) || '***' || CASE WHEN contains({0}, ' ') "
                "THEN ' ' || split_part({0}, ' ', -1) ELSE '' END" if role == "CARE_MGR"
                else "'***REDACTED***'")
        dob = "birth_date" if full else "make_date(year(birth_date), 1, 1)"
        postal = "postal_code" if full else "left(postal_code, 3) || 'XX'"
        parts.append(
            f"SELECT '{role}' AS role, patient_id, {name.format('full_name')} AS full_name, "
            f"{name.format('first_name')} AS first_name, {name.format('last_name')} AS last_name, "
            f"{dob} AS birth_date, {postal} AS postal_code, attributed_clinic "
            f"FROM t_dim WHERE {_rows_for(role)}")
    return "\nUNION ALL\n".join(parts)


def _masked_chunks() -> str:
    parts = []
    for role in _MASK_ROLES:
        text = ("chunk_text" if role != "ANALYST"
                else "'***CLINICAL NARRATIVE WITHHELD FOR THIS ROLE***'")
        rows = ("true" if role not in _CLINICS else
                f"c.patient_id IS NULL OR {_rows_for(role, 'd.attributed_clinic')}")
        parts.append(f"SELECT '{role}' AS role, c.citation_label, c.file_name, {text} AS chunk_text "
                     f"FROM t_chunks c LEFT JOIN t_dim d ON c.patient_id = d.patient_id "
                     f"WHERE {rows}")
    return "\nUNION ALL\n".join(parts)


# Fixed value: the text shown for a withheld one.
_WITHHELD = "'***CLINICAL NARRATIVE WITHHELD FOR THIS ROLE***'"
_PLAIN_SCORE = ("CASE WHEN contains({0}, 'documented barrier: ') THEN left({0}, "
                "instr({0}, 'documented barrier: ') + 19) || 'withheld)' || {1} ELSE {0} END")


def _masked_ledger() -> str:
    parts = []
    score = _PLAIN_SCORE.format("evidence_text",
                                "substr(evidence_text, instr(evidence_text, ' | Methodology: '))")
    for role in _MASK_ROLES:
        rows = ("true" if role not in _CLINICS else
                f"c.patient_id IS NULL OR {_rows_for(role, 'd.attributed_clinic')}")
        text = ("evidence_text" if role != "ANALYST" else
                f"CASE WHEN evidence_class = 'DOCUMENT' THEN {_WITHHELD} "
                f"WHEN source_type = 'RISK_SCORE' THEN {score} ELSE evidence_text END")
        parts.append(
            f"SELECT '{role}' AS role, evidence_class, source_id, locator, c.patient_id, "
            f"source_type, {text} AS evidence_text "
            f"FROM t_ledger c LEFT JOIN t_dim d ON c.patient_id = d.patient_id WHERE {rows}")
    return "\nUNION ALL\n".join(parts)


def _masked_360() -> str:
    parts = []
    for role in _MASK_ROLES:
        full, care = role in ("ADMIN", "CLINICIAN"), role != "ANALYST"
        name = ("full_name" if full else "left(full_name, 1) || '***' || CASE WHEN contains(full_name, "
                "' ') THEN ' ' || split_part(full_name, ' ', -1) ELSE '' END" if role == "CARE_MGR"
                else "'***REDACTED***'")
        born = "birth_date" if full else "make_date(year(birth_date), 1, 1)"
        held = ["barrier_to_care", "documented_adverse_event"]
        shown = ", ".join(f"{c if care else _WITHHELD} AS {c}" for c in held)
        parts.append(f"SELECT '{role}' AS role, patient_id, {name} AS full_name, {born} AS birth_date, "
                     f"attributed_clinic, {shown} FROM t_p360 WHERE {_rows_for(role)}")
    return "\nUNION ALL\n".join(parts)


def _masked_risk() -> str:
    plain = _PLAIN_SCORE.format("score_explanation", "''")
    return "\nUNION ALL\n".join(
        f"SELECT '{role}' AS role, patient_id, attributed_clinic, lace_index, "
        f"{plain if role == 'ANALYST' else 'score_explanation'} AS score_explanation "
        f"FROM t_risk WHERE {_rows_for(role)}" for role in _MASK_ROLES)


def _row_access() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{role}' AS role, attributed_clinic, count(*) AS patients FROM t_dim "
        f"WHERE {_rows_for(role)} GROUP BY attributed_clinic" for role in _MASK_ROLES)


_SCORECARD = """
SELECT CAST(asked_at AS DATE) AS day, asked_role, count(*) AS answers,
       count(*) FILTER (grounded) AS grounded_answers,
       round(100.0::DOUBLE * (count(*) FILTER (grounded)) / count(*), 1) AS grounded_pct,
       round(avg(n_citations), 2) AS avg_citations_per_answer,
       round(avg(latency_ms), 0) AS avg_latency_ms
FROM t_audit GROUP BY ALL"""

def _chunk_search(scope: str, queries: str, attribute: str, k: int) -> str:
    """Best chunks of a scope for each query; `wanted`, if given, must equal the attribute."""
    terms = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
    return f"""
SELECT * FROM (WITH pool AS (
  SELECT citation_label, doc_id, doc_type, section_heading, chunk_text, {attribute} AS attribute,
         {terms.format('chunk_text')} AS toks FROM t_chunks WHERE scope = '{scope}'),
cells AS (SELECT citation_label, attribute, len(toks) AS len, term, count(*) AS tf
          FROM (SELECT *, unnest(toks) AS term FROM pool) GROUP BY ALL),
spread AS (SELECT term, count(*) AS df FROM cells GROUP BY term),
sizes AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM pool),
asked AS (SELECT qid, wanted, len(ts) AS many, unnest(ts) AS term
          FROM (SELECT qid, wanted, list_distinct({terms.format('question')}) AS ts FROM ({queries}))),
scored AS (
  SELECT qid, citation_label,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
                   / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 4) AS score,
         round(count(*) / max(many)::DOUBLE, 4) AS coverage
  FROM asked JOIN cells USING (term) JOIN spread USING (term), sizes
  WHERE wanted IS NULL OR wanted = attribute GROUP BY qid, citation_label),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, citation_label) AS INTEGER)
              AS rank FROM scored WHERE score > 0)
SELECT qid, citation_label, doc_id, doc_type, section_heading, chunk_text, score, coverage, rank
FROM ranked JOIN pool USING (citation_label) WHERE rank <= {k})"""


# The wording of the judge prompt.
_JUDGE = """'You are grading a clinical copilot. Data is fully synthetic.' || chr(10) || chr(10)
  || 'QUESTION: ' || question || chr(10) || 'QUESTION CLASS: ' || question_class || chr(10)
  || 'EXPECTED EVIDENCE: ' || expected_evidence || chr(10)
  || 'ANSWER: ' || coalesce(answer_text, '(no answer)') || chr(10) || chr(10)
  || 'Return ONLY minified JSON with keys grounding, citation_quality, refusal_correctness, '
  || 'completeness (each an integer 0-5) and rationale (one sentence). '
  || 'grounding: is every factual claim traceable to a named source? '
  || 'citation_quality: are citations specific to a document ID and section rather than vague? '
  || 'refusal_correctness: if the class is REFUSAL_EXPECTED, did it correctly decline and say '
  || 'the corpus lacks evidence? Score 5 for a clean refusal, 0 for answering anyway. '
  || 'For all other classes score 5 unless it wrongly refused. '
  || 'completeness: did it answer every part of the question?'"""

_COSINE = """round(list_dot_product(e.v, c.q)
    / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.q, c.q))), 4)"""

STATEMENTS: dict[str, str] = {
    # Scans, dimension, rollups
    "html_title_scan": "SELECT page_id, title, body_text FROM t_html",
    "csv_extract": """
SELECT patient_id, member_id, first_name, last_name, birth_date, sex, city, state, postal_code,
       primary_language, pcp_npi, 0 AS deceased_flag, data_source FROM t_patients""",
    "partitioned_table": """
SELECT attributed_clinic, count(*) AS patients, max(birth_date) AS youngest FROM t_dim
GROUP BY attributed_clinic""",
    "appended_log": """
SELECT if(hour(asked_at) < 12, 'night', 'day') AS asked_by, asked_role, count(*) AS answers,
       count(*) AS ids FROM t_audit GROUP BY ALL""",
    "fact_claims": """
SELECT *, CAST(2 * allowed_amount AS DECIMAL(18,2)) AS billed_amount,
       CASE WHEN claim_type = 'FACILITY'
            THEN 'DRG' || (CAST(split_part(claim_id, '-', 4) AS BIGINT) % 111 + 190) END AS drg_code
FROM t_claims""",
    "ed_visits": """
SELECT concat('SYN-P', o_custkey) AS patient_id, count(*) AS visits,
       CAST(count(*) FILTER (o_orderkey % 5 = 0) AS BIGINT) AS admitted,
       max(CAST(o_orderdate AS DATE)) AS last_visit
FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey""",
    "dim_patient": "SELECT * FROM t_dim",
    "patient_utilization": "SELECT * FROM t_util",
    "last_admission": "SELECT * EXCLUDE (readmit_30d) FROM t_last",
    "patient_burden": "SELECT * FROM t_burden",
    "patient_pharmacy": "SELECT * FROM t_pharmacy",
    "patient_labs": "SELECT * FROM t_lab_roll",
    "newest_labs": """
SELECT patient_id, max(result_value) FILTER (loinc_code = '4548-4' AND newest) AS newest_a1c,
       max(result_value) FILTER (loinc_code = '2160-0' AND newest) AS newest_creatinine,
       max(result_value) FILTER (loinc_code = '33762-6' AND newest) AS newest_ntprobnp,
       max(result_value) FILTER (loinc_code = '2823-3' AND newest) AS newest_potassium
FROM (SELECT *, collected_date = max(collected_date) OVER (PARTITION BY patient_id, loinc_code)
                AS newest FROM t_labs) GROUP BY patient_id""",
    "patient_financial": "SELECT * FROM t_financial",
    "patient_signals": "SELECT * FROM t_signal_roll",
    # 360, risk, gaps
    "patient_360": "SELECT * FROM t_p360",
    "member_360": "SELECT * FROM t_member_360",
    "lace_points": f"SELECT patient_id, {_POINTS}, lace_index FROM t_points",
    "risk_readmission": "SELECT * EXCLUDE (full_name) FROM t_risk",
    "risk_explanation": "SELECT patient_id, score_explanation, methodology_citation FROM t_risk",
    "score_components": """
SELECT patient_id, 'L -- length of stay' AS component, l_points AS points,
       'yes' AS in_published_index FROM t_points
UNION ALL SELECT patient_id, 'A -- acuity of admission', a_points, 'yes' FROM t_points
UNION ALL SELECT patient_id, 'C -- comorbidity (Charlson)', c_points, 'yes' FROM t_points
UNION ALL SELECT patient_id, 'E -- ED visits, prior 6 months', e_points, 'yes' FROM t_points
UNION ALL SELECT patient_id, 'Local: adherence', mod_adherence_point, 'no' FROM t_points
UNION ALL SELECT patient_id, 'Local: documented barrier', mod_barrier_point, 'no' FROM t_points""",
    "risk_band_distribution": """
SELECT risk_band, count(*) AS patients, round(avg(lace_index), 2) AS avg_lace,
       round(avg(adjusted_score), 2) AS avg_adjusted FROM t_points GROUP BY risk_band""",
    "band_calibration": """
SELECT risk_band, count(*) AS patients, round(avg(lace_index), 3) AS avg_lace,
       round(avg(readmit_30d), 3) AS observed_readmit_rate
FROM t_points LEFT JOIN (SELECT patient_id, readmit_30d FROM t_last) USING (patient_id)
GROUP BY risk_band""",
    "care_gaps": "SELECT * FROM t_gaps",
    "patient_gap_counts": """
SELECT p.patient_id, count(g.gap_type) AS open_gaps
FROM t_p360 p LEFT JOIN t_gaps g USING (patient_id) GROUP BY p.patient_id""",
    "gaps_by_document": """
SELECT governing_document_id, gap_type, count(*) AS open_gaps FROM t_gaps
GROUP BY governing_document_id, gap_type""",
    # Quality
    "dq_checks": "SELECT * FROM t_dq",
    "dq_gate": """
SELECT count(*) AS checks, CAST(sum(failing_rows) AS BIGINT) AS failing_rows,
       sum(failing_rows) = 0 AS released FROM t_dq""",
    "column_tests": """
SELECT 'not_null_claim_id' AS check_name, count(*) AS failing_rows, 'claim_id is null' AS detail
FROM t_claims WHERE claim_id IS NULL
UNION ALL SELECT 'not_null_denial_reason', count(*), 'denial_reason is null'
FROM t_claims WHERE denial_reason IS NULL
UNION ALL SELECT 'accepted_values_claim_status', count(*), 'claim_status outside its value list'
FROM t_claims WHERE claim_status NOT IN ('PAID', 'DENIED')
UNION ALL SELECT 'unique_claim_id', CAST(coalesce(sum(n), 0) AS BIGINT), 'claim_id repeats'
FROM (SELECT count(*) AS n FROM t_claims GROUP BY claim_id HAVING count(*) > 1)
UNION ALL SELECT 'unique_encounter_id', CAST(coalesce(sum(n), 0) AS BIGINT), 'encounter_id repeats'
FROM (SELECT count(*) AS n FROM t_claims GROUP BY encounter_id HAVING count(*) > 1)
UNION ALL SELECT 'references_patient_id', count(*), 'patient_id without a parent'
FROM t_claims WHERE patient_id NOT IN (SELECT patient_id FROM t_patients)""",
    "identifier_scan": r"""
SELECT 'text' AS column_name, 'ssn_shape' AS pattern_name, count(*) AS rows_scanned,
       count(*) FILTER (regexp_matches(text,
         '(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}([^0-9]|$)')) AS rows_matching FROM documents
UNION ALL
SELECT 'text', 'email', count(*), count(*) FILTER (regexp_matches(text,
         '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) FROM documents""",
    # Documents
    "doc_metadata": "SELECT * FROM t_meta",
    "doc_chunks": "SELECT * FROM t_chunks",
    "citation_labels": "SELECT doc_id, chunk_index, section_heading, citation_label FROM t_chunks",
    "doc_signals": "SELECT * FROM t_signals_raw",
    "safety_flags": "SELECT * FROM t_signals",
    "doc_type_summary": """
SELECT doc_type, count(DISTINCT doc_id) AS docs, count(*) AS chunks FROM t_chunks
GROUP BY doc_type""",
    "linked_documents": """
SELECT DISTINCT patient_id, doc_id, doc_title, doc_type, effective_date FROM t_chunks
WHERE patient_id IS NOT NULL""",
    # Ledger
    "evidence_ledger": "SELECT * FROM t_ledger",
    "evidence_pack": "SELECT * FROM t_packs WHERE pack_row <= 120",
    "one_evidence_pack": "SELECT * EXCLUDE (patient_id) FROM t_ledger WHERE patient_id = 'SYN-P42'",
    "patient_profile": """
SELECT s.patient_id, p.full_name, p.attributed_clinic, lace_index, adjusted_score, risk_band,
       score_explanation, (SELECT count(*) FROM t_gaps g WHERE g.patient_id = 'SYN-P42') AS open_gaps
FROM t_risk s JOIN t_p360 p USING (patient_id) WHERE patient_id = 'SYN-P42'""",
    "full_record_top_risk": """
SELECT * FROM t_packs WHERE patient_id = (
  SELECT patient_id FROM t_points
  ORDER BY adjusted_score DESC, lace_index DESC, patient_id LIMIT 1)""",
    # Dashboard
    "kpi_strip": """
SELECT (SELECT count(*) FROM t_p360) AS patients, (SELECT count(*) FROM t_encounters) AS encounters,
       (SELECT count(DISTINCT doc_id) FROM t_meta) AS documents,
       (SELECT count(*) FROM t_gaps) AS open_gaps,
       (SELECT round(avg(lace_index), 1) FROM t_points) AS avg_lace""",
    "object_counts": """
SELECT 'Patients' AS object, count(*) AS n FROM t_p360
UNION ALL SELECT 'Encounters', count(*) FROM t_encounters
UNION ALL SELECT 'Claims', count(*) FROM t_claims
UNION ALL SELECT 'Documents', count(DISTINCT doc_id) FROM t_meta
UNION ALL SELECT 'Document chunks', count(*) FROM t_chunks""",
    "risk_roster": """
SELECT patient_id, full_name, risk_band, lace_index, adjusted_score, attributed_clinic FROM t_risk
ORDER BY adjusted_score DESC, lace_index DESC, patient_id LIMIT 60""",
    "active_medications": """
SELECT patient_id, medication_name, drug_class, adherence_pdc, days_supply FROM t_medications
WHERE active_flag = 1""",
    "recent_labs": """
SELECT patient_id, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY collected_date DESC,
         test_name, result_value DESC) AS INTEGER) AS row_in_patient, collected_date, test_name,
       result_value, unit, ref_low, ref_high, abnormal_flag
FROM t_labs QUALIFY row_in_patient <= 12""",
    "lab_pivot": """
SELECT patient_id, collected_date,
  round(avg(CAST(result_value AS DOUBLE)) FILTER (test_name = 'Hemoglobin A1c'), 4)
    AS hemoglobin_a1c,
  round(avg(CAST(result_value AS DOUBLE)) FILTER (test_name = 'Creatinine, serum'), 4)
    AS creatinine__serum,
  round(avg(CAST(result_value AS DOUBLE)) FILTER (test_name = 'NT-proBNP'), 4) AS nt_probnp,
  round(avg(CAST(result_value AS DOUBLE)) FILTER (test_name = 'Potassium, serum'), 4)
    AS potassium__serum,
  round(avg(CAST(result_value AS DOUBLE)) FILTER (test_name = 'Hemoglobin'), 4) AS hemoglobin
FROM t_labs GROUP BY patient_id, collected_date""",
    "clinic_risk": """
SELECT p.attributed_clinic, count(r.patient_id) AS total_patients,
       round(avg(r.adjusted_score), 2) AS avg_risk_score
FROM t_points r JOIN t_dim p USING (patient_id) GROUP BY p.attributed_clinic""",
    "clinic_gaps": """
SELECT p.attributed_clinic, count(g.gap_type) AS total_open_gaps
FROM t_gaps g JOIN t_dim p USING (patient_id) GROUP BY p.attributed_clinic""",
    # Questions
    "top_risk_at_clinic": f"""
SELECT attributed_clinic, patient_id, lace_index, adjusted_score, {_POINTS}, score_explanation
FROM t_risk QUALIFY row_number() OVER (PARTITION BY attributed_clinic
  ORDER BY adjusted_score DESC, lace_index DESC, patient_id) = 1""",
    "latest_admission_summary": """
SELECT r.patient_id, r.full_name, r.lace_index, r.risk_band, r.score_explanation,
       coalesce((SELECT string_agg(gap_type, ', ' ORDER BY gap_type) FROM t_gaps g
                 WHERE g.patient_id = r.patient_id), '') AS gap_types,
       e.encounter_id, e.start_date
FROM t_risk r JOIN (SELECT * FROM t_encounters WHERE encounter_type = 'INPATIENT'
                    ORDER BY start_date DESC NULLS LAST, encounter_id DESC LIMIT 1) e
  USING (patient_id)""",
    "clinic_comparison": """
SELECT attributed_clinic, avg(lace_index) AS avg_lace_index, max(n) AS open_gap_count
FROM t_points LEFT JOIN (SELECT attributed_clinic, count(*) AS n FROM t_gaps
                         GROUP BY attributed_clinic) USING (attributed_clinic)
WHERE attributed_clinic IN ('AFRICA', 'AMERICA') GROUP BY attributed_clinic""",
    "chf_no_gdmt_cohort": f"""
SELECT patient_id, attributed_clinic, lace_index, risk_band, {_POINTS}, score_explanation,
       'PA-CARD-014' AS governing_document_id
FROM t_risk WHERE patient_id IN (SELECT patient_id FROM t_gaps
                                 WHERE gap_type = 'CHF_NO_GDMT_ON_FILE')""",
    "step_therapy_failures": """
SELECT patient_id, attributed_clinic, on_sglt2, latest_a1c FROM t_p360
WHERE has_t2dm AND NOT on_metformin""",
    "high_utilizers": """
SELECT patient_id, inpatient_stays, diagnoses
FROM (SELECT patient_id, count(*) AS inpatient_stays FROM t_encounters
      WHERE encounter_type = 'INPATIENT' AND start_date >= DATE '2001-08-01' - INTERVAL 12 MONTH
      GROUP BY patient_id HAVING count(*) > 1)
LEFT JOIN (SELECT patient_id, string_agg(icd10_code, ', ' ORDER BY icd10_code) AS diagnoses
           FROM (SELECT DISTINCT patient_id, icd10_code FROM t_diagnoses
                 WHERE clinical_status = 'active') GROUP BY patient_id) USING (patient_id)""",
    "potassium_on_arni_mra": """
SELECT patient_id, attributed_clinic, latest_potassium, on_arni, on_mra FROM t_p360
WHERE latest_potassium > 5.4 AND (on_arni OR on_mra)""",
    "clinic_readmit_drivers": """
SELECT attributed_clinic, count(*) AS patients, round(avg(any_readmit_30d), 4) AS readmission_rate,
       round(avg(a_points), 4) AS avg_a_points, round(avg(c_points), 4) AS avg_c_points
FROM t_points GROUP BY attributed_clinic""",
    "gaps_by_lob": """
SELECT line_of_business, gap_type, governing_document_id, count(*) AS open_gaps,
       count(DISTINCT patient_id) AS patients FROM t_gaps
GROUP BY line_of_business, gap_type, governing_document_id""",
    # Semantic layer
    "age_band_mix": """
SELECT CASE WHEN age_years < 45 THEN '19-44' WHEN age_years < 65 THEN '45-64' ELSE '65+' END
         AS age_band, count(DISTINCT patient_id) AS patient_count, avg(age_years) AS avg_age
FROM t_p360 GROUP BY 1""",
    "sv_clinic_band": """
SELECT attributed_clinic, risk_band, count(DISTINCT patient_id) AS patient_count,
       avg(lace_index) AS avg_lace_index FROM t_points GROUP BY attributed_clinic, risk_band""",
    "sv_high_risk_share": """
SELECT line_of_business, count(DISTINCT CASE WHEN risk_band = 'HIGH' THEN patient_id END)
         AS high_risk_count,
       count(DISTINCT CASE WHEN risk_band = 'HIGH' THEN patient_id END)::DOUBLE
         / count(DISTINCT patient_id) AS high_risk_share
FROM t_points GROUP BY line_of_business""",
    "sv_high_risk_panel": """
SELECT patient_id, risk_band, score_explanation, attributed_clinic,
       CAST(lace_index AS DOUBLE) AS avg_lace_index FROM t_risk WHERE risk_band = 'HIGH'""",
    "sv_readmit_by_clinic": """
SELECT attributed_clinic, count(DISTINCT patient_id) AS patient_count,
       sum(any_readmit_30d)::DOUBLE / count(DISTINCT patient_id) AS readmission_rate
FROM t_p360 GROUP BY attributed_clinic""",
    "sv_gaps_by_lob": """
SELECT line_of_business, gap_type, governing_document_id, count(*) AS open_gap_count FROM t_gaps
GROUP BY line_of_business, gap_type, governing_document_id""",
    "sv_denial_reasons": """
SELECT denial_reason, count(*) FILTER (claim_status = 'DENIED')::DOUBLE / count(*) AS denial_rate,
       CAST(sum(allowed_amount) AS DECIMAL(28,2)) AS total_allowed FROM t_claims
GROUP BY denial_reason""",
    "sv_scoreboard": """
SELECT p.attributed_clinic, p.patient_count, p.avg_age, p.total_cost, p.cost_per_patient,
       p.readmission_rate, p.avg_worst_pdc, r.avg_lace_index, r.high_risk_count,
       r.high_risk_share, g.open_gap_count, g.patients_with_gaps, e.encounter_total,
       e.avg_length_of_stay, c.total_allowed, c.total_paid, c.denial_rate
FROM (SELECT attributed_clinic, count(DISTINCT patient_id) AS patient_count,
             sum(age_years)::DOUBLE / count(age_years) AS avg_age,
             CAST(sum(total_allowed_amount) AS DECIMAL(38,2)) AS total_cost,
             CAST(sum(total_allowed_amount) AS DOUBLE) / count(DISTINCT patient_id)
               AS cost_per_patient,
             sum(any_readmit_30d)::DOUBLE / count(DISTINCT patient_id) AS readmission_rate,
             CAST(sum(worst_pdc) AS DOUBLE) / count(worst_pdc) AS avg_worst_pdc
      FROM t_p360 GROUP BY attributed_clinic) p
LEFT JOIN (SELECT attributed_clinic, avg(lace_index) AS avg_lace_index,
             count(DISTINCT CASE WHEN risk_band = 'HIGH' THEN patient_id END) AS high_risk_count,
             count(DISTINCT CASE WHEN risk_band = 'HIGH' THEN patient_id END)::DOUBLE
               / count(DISTINCT patient_id) AS high_risk_share
           FROM t_points GROUP BY attributed_clinic) r USING (attributed_clinic)
LEFT JOIN (SELECT attributed_clinic, count(*) AS open_gap_count,
             count(DISTINCT patient_id) AS patients_with_gaps
           FROM t_gaps GROUP BY attributed_clinic) g USING (attributed_clinic)
LEFT JOIN (SELECT attributed_clinic, count(DISTINCT encounter_id) AS encounter_total,
             sum(length_of_stay_days)::DOUBLE / count(length_of_stay_days) AS avg_length_of_stay
           FROM t_encounters JOIN t_dim USING (patient_id)
           GROUP BY attributed_clinic) e USING (attributed_clinic)
LEFT JOIN (SELECT attributed_clinic, CAST(sum(allowed_amount) AS DECIMAL(38,2)) AS total_allowed,
             CAST(sum(paid_amount) AS DECIMAL(38,2)) AS total_paid,
             count(*) FILTER (claim_status = 'DENIED')::DOUBLE / count(*) AS denial_rate
           FROM t_claims JOIN t_dim USING (patient_id)
           GROUP BY attributed_clinic) c USING (attributed_clinic)""",
    "sv_terms": r"""
SELECT q.question AS term, q.times_asked, t.kind, t.entity, t.name
FROM (SELECT question, count(*) AS times_asked FROM t_audit GROUP BY question) q
LEFT JOIN t_terms t ON t.term = lower(trim(regexp_replace(q.question, '[ \t\n]+', ' ', 'g')))""",
    # Retrieval
    "term_stats": """
SELECT term, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS occurrences FROM t_postings
GROUP BY term""",
    "bm25_topk": "SELECT * FROM t_bm25_top",
    "no_evidence": """
SELECT qid, question FROM t_golden
WHERE qid NOT IN (SELECT qid FROM t_bm25 WHERE score > 0 AND coverage >= 0.35)""",
    "note_search": _chunk_search(
        "PATIENT_SPECIFIC", "SELECT patient_id AS qid, 'barriers documented transportation cost "
        "caregiver' AS question, patient_id AS wanted FROM t_dim", "patient_id", 6),
    "policy_search": _chunk_search(
        "INSTITUTIONAL", "SELECT qid, question, NULL AS wanted FROM t_golden UNION ALL "
        "SELECT qid || '/' || t, question, t FROM t_golden, (SELECT unnest(['UTILIZATION_POLICY', "
        "'REGULATORY_BULLETIN', 'QUALITY_MEASURE']) AS t)", "doc_type", 8),
    "text_search": "SELECT * FROM t_bm25_top",
    "distinct_estimates": """
SELECT claim_status, count(DISTINCT patient_id) AS patients, true AS close FROM t_claims GROUP BY claim_status""",
    "similar_documents": """
SELECT * FROM (WITH freq AS (SELECT term, count(*) AS df FROM t_postings GROUP BY term),
sizes AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM t_tokens),
ideas AS (
  SELECT doc_id AS qid, term, row_number() OVER (PARTITION BY doc_id ORDER BY
           round(tf * ln(1 + (n - df + 0.5) / (df + 0.5)), 6) DESC, term) AS place
  FROM t_postings JOIN freq USING (term), sizes WHERE doc_id % 50 = 0),
scored AS (
  SELECT qid, doc_id,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
                   / (tf + 1.2 * (0.25 + 0.75 * doc_length / mean))), 4) AS score,
         round(count(*)::DOUBLE / max(many), 4) AS coverage
  FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS many FROM ideas WHERE place <= 12)
    JOIN t_postings USING (term) JOIN freq USING (term), sizes
  GROUP BY qid, doc_id)
SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank
FROM scored WHERE score > 0 QUALIFY rank <= 8)""",
    "vector_topk": f"""
SELECT CAST(c.label AS INTEGER) AS qid, e.vec_id, {_COSINE} AS score,
       CAST(row_number() OVER (PARTITION BY c.label ORDER BY {_COSINE} DESC, e.vec_id) AS INTEGER)
         AS rank
FROM t_vectors e JOIN t_centroids c ON e.label = c.label QUALIFY rank <= 8""",
    "vector_neighbours": f"""
SELECT c.qid, e.vec_id, {_COSINE} AS score,
       CAST(row_number() OVER (PARTITION BY c.qid ORDER BY {_COSINE} DESC, e.vec_id) AS INTEGER) AS rank
FROM t_vectors e CROSS JOIN (SELECT vec_id AS qid, v AS q FROM t_vectors WHERE vec_id % 50 = 0) c
QUALIFY rank <= 8""",
    "hybrid_topk": f"""
SELECT qid, doc_id, score, rank
FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER)
         AS rank
  FROM (
    SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score
    FROM (
      SELECT qid, doc_id, rank FROM t_bm25_top
      UNION ALL
      SELECT g.qid, e.vec_id, CAST(row_number() OVER (PARTITION BY g.qid
               ORDER BY {_COSINE} DESC, e.vec_id) AS INTEGER) AS rank
      FROM t_golden g JOIN t_centroids c
        ON c.label = (CAST(substr(g.qid, 2) AS INTEGER) - 1) % 10
      CROSS JOIN t_vectors e QUALIFY rank <= 8)
    GROUP BY qid, doc_id))
WHERE rank <= 8""",
    "patient_lookup": r"""
SELECT qid, patient_id, full_name, attributed_clinic, line_of_business, score, coverage, phrase,
       distance, rank
FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, distance, patient_id)
                 AS INTEGER) AS rank
  FROM (
    SELECT qid, patient_id, full_name, attributed_clinic, line_of_business, phrase,
           CAST(levenshtein(lower(phrase), lower(full_name)) AS INTEGER) AS distance,
           round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
             / (tf + 1.2 * (0.25 + 0.75 * doc_length / mean_length))), 4) AS score,
           round(count(*) / max(asked)::DOUBLE, 4) AS coverage
    FROM (SELECT patient_id, full_name, attributed_clinic, line_of_business,
                 len(toks) AS doc_length, term, count(*) AS tf
          FROM (SELECT *, unnest(toks) AS term FROM t_blobs) GROUP BY ALL)
    JOIN (SELECT qid, phrase, len(terms) AS asked, unnest(terms) AS term
          FROM (SELECT qid, phrase, list_distinct(regexp_extract_all(lower(phrase),
                  '[\p{L}\p{N}]+')) AS terms FROM t_phrases)) USING (term)
    JOIN (SELECT term, count(*) AS df FROM (SELECT DISTINCT patient_id, unnest(toks) AS term
                                            FROM t_blobs) GROUP BY term) USING (term)
    CROSS JOIN (SELECT count(*) AS n, avg(len(toks)) AS mean_length FROM t_blobs)
    GROUP BY qid, patient_id, full_name, attributed_clinic, line_of_business, phrase))
WHERE rank <= 5""",
    "name_lookup": r"""
SELECT * FROM (WITH bearers AS (
  SELECT DISTINCT patient_id, full_name, unnest(regexp_extract_all(lower(full_name), '[\p{L}\p{N}]+')) AS word
  FROM t_dim),
phrases AS (
  SELECT patient_id AS qid, left(first_name, 4) || ' ' || left(last_name, len(last_name) - 2) || 'x'
           || right(last_name, 1) AS phrase
  FROM t_dim WHERE CAST(substr(patient_id, 6) AS BIGINT) % 50 = 0),
asked AS (SELECT DISTINCT qid, phrase, unnest(regexp_extract_all(lower(phrase), '[\p{L}\p{N}]+')) AS a
          FROM phrases),
words AS (SELECT DISTINCT word FROM bearers),
pairs AS (
  SELECT a, word, CASE WHEN word = a THEN 0 WHEN starts_with(word, a) THEN 1 ELSE levenshtein(a, word) + 1 END
                    AS penalty
  FROM (SELECT DISTINCT a FROM asked), words
  WHERE starts_with(word, a) OR levenshtein(a, word) <= CASE WHEN len(a) >= 8 THEN 2 WHEN len(a) >= 4 THEN 1
                                                             ELSE 0 END),
hits AS (SELECT qid, phrase, patient_id, full_name, a, min(penalty) AS p
         FROM asked JOIN pairs USING (a) JOIN bearers USING (word) GROUP BY ALL),
people AS (
  SELECT qid, patient_id, full_name, CAST(count(*) AS INTEGER) AS matched, CAST(sum(p) AS BIGINT) AS penalty,
         CAST(levenshtein(lower(phrase), lower(full_name)) AS INTEGER) AS distance
  FROM hits GROUP BY qid, phrase, patient_id, full_name)
SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY penalty, distance, patient_id) AS INTEGER) AS rank
FROM (SELECT * FROM people QUALIFY matched = max(matched) OVER (PARTITION BY qid))
QUALIFY rank <= 5)""",
    # Governance
    "row_access": _row_access(),
    "masked_panel": _masked_panel(),
    "masked_chunks": _masked_chunks(),
    "masked_360": _masked_360(),
    "masked_risk": _masked_risk(),
    "masked_ledger": _masked_ledger(),
    "grounding_scorecard": _SCORECARD,
    "scorecard_daily": _SCORECARD,
    # Evaluation
    "golden_class_counts": """
SELECT question_class, count(*) AS questions, CAST(sum(coalesce(n, 0)) AS BIGINT) AS answers
FROM t_golden LEFT JOIN (SELECT qid, count(*) AS n FROM t_runs GROUP BY qid) USING (qid)
GROUP BY question_class""",
    "eval_routing": """
SELECT run_id, qid, question_class, run_at, latency_ms,
       CAST(len(list_intersect(tools_observed, expected_tools)) AS INTEGER) AS tools_matched,
       CAST(len(expected_tools) AS INTEGER) AS tools_expected,
       CAST(len(citations_observed) AS INTEGER) AS citation_count
FROM t_runs JOIN t_golden USING (qid)""",
    "judge_prompts": f"""
SELECT run_id, qid, {_JUDGE} AS judge_prompt FROM t_runs JOIN t_golden USING (qid)""",
    "judge_scores": """
SELECT run_id, qid, latency_ms, grounding, citation_quality, refusal_correctness, completeness
FROM t_scores""",
    "eval_summary": """
SELECT run_id, min(run_at) AS run_at, count(*) AS questions_scored,
       round(avg(grounding), 2) AS avg_grounding,
       round(avg(citation_quality), 2) AS avg_citation_quality,
       round(avg(refusal_correctness), 2) AS avg_refusal_correctness,
       round(avg(completeness), 2) AS avg_completeness,
       round(100.0::DOUBLE * sum(len(list_intersect(tools_observed, expected_tools)))
             / sum(len(expected_tools)), 1) AS tool_routing_pct,
       round(avg(len(citations_observed)), 2) AS avg_citations,
       round(avg(latency_ms), 0) AS avg_latency_ms
FROM t_scores JOIN t_golden USING (qid) GROUP BY run_id""",
    "citation_audit": """
SELECT locator, count(*) AS times_cited
FROM (SELECT unnest(citations_observed) AS locator FROM t_runs)
WHERE locator NOT IN (SELECT locator FROM t_ledger) GROUP BY locator""",
}
