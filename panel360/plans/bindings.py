"""The generic sales, event and text tables read as clinical ones, so that every operator can run
on them at any scale factor. Only renamings and row-local expressions, and the joins the source
tables need to find their patient."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import cached_property
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from panel360.plans.panel import Panel
from panel360.schemas import EXTRACTS
from panel360.sources.documents import parse_html
from panel360.sources.extracts import conform

AS_OF = dt.date(2001, 8, 1)
# Clinics are the five regions; who may see which follows the published pattern of two and four.
CLINIC_ENTITLEMENTS = (("CLINICIAN", "AFRICA"), ("CLINICIAN", "AMERICA"),
                       ("CARE_MGR", "AFRICA"), ("CARE_MGR", "AMERICA"),
                       ("CARE_MGR", "ASIA"), ("CARE_MGR", "EUROPE"))
TEST_NAMES = ("Hemoglobin A1c", "Creatinine, serum", "NT-proBNP", "Potassium, serum", "Hemoglobin")

PLACED = """(SELECT * FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey
             LEFT JOIN {region} ON n_regionkey = r_regionkey)"""

PATIENTS = f"""
SELECT concat('SYN-P', c_custkey) AS patient_id, concat('SYN-M', c_custkey) AS member_id,
       split_part(c_name, '#', 1) AS first_name,
       concat(c_mktsegment, '-', split_part(c_name, '#', 2)) AS last_name,
       date_add(DATE '1930-01-01', CAST(c_custkey * 37 % 26000 AS INT)) AS birth_date,
       CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, n_name AS city, r_name AS state,
       CAST(c_custkey % 90000 + 10000 AS STRING) AS postal_code,
       CASE WHEN c_custkey % 5 = 0 THEN 'ES' ELSE 'EN' END AS primary_language,
       concat('NPI', c_nationkey) AS pcp_npi, 0 AS deceased_flag, 'DRIVER_TABLES' AS data_source
FROM {PLACED}"""

MEMBERS = f"""
SELECT concat('SYN-M', c_custkey) AS member_id, concat('SYN-P', c_custkey) AS patient_id,
       concat('Payer ', c_nationkey % 3) AS payer_name, concat('PLAN-', c_custkey % 5) AS plan_id,
       c_mktsegment AS line_of_business,
       date_add(DATE '1995-01-01', CAST(c_custkey % 1000 AS INT)) AS enroll_start,
       CAST(NULL AS DATE) AS enroll_end,
       CASE WHEN c_custkey % 4 = 0 THEN 'CARE_MGMT' ELSE 'NONE' END AS risk_program,
       r_name AS attributed_clinic
FROM {PLACED}"""

KIND = """CASE o_orderpriority WHEN '1-URGENT' THEN 'EMERGENCY' WHEN '2-HIGH' THEN 'INPATIENT'
                            WHEN '3-MEDIUM' THEN 'OUTPATIENT' ELSE 'TELEHEALTH' END"""

ENCOUNTERS = f"""
SELECT concat('SYN-E', o_orderkey) AS encounter_id, concat('SYN-P', o_custkey) AS patient_id,
       kind AS encounter_type, started AS start_date, date_add(started, stay) AS end_date,
       stay AS length_of_stay_days,
       CASE WHEN kind <> 'INPATIENT' THEN 'N/A' WHEN o_orderstatus = 'F' THEN 'EMERGENCY'
            ELSE 'ELECTIVE' END AS admission_source,
       CASE WHEN kind <> 'INPATIENT' THEN 'N/A'
            ELSE get(array('HOME', 'HOME_HEALTH', 'SNF'), CAST(o_orderkey % 3 AS INT)) END
         AS discharge_disposition,
       concat('Facility ', o_orderkey % 3) AS facility,
       CAST(o_orderkey % 5 = 0 AS INT) AS readmit_30d
FROM (SELECT *, CAST(o_orderdate AS DATE) AS started, {KIND} AS kind,
             CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(o_orderkey % 16 AS INT) ELSE 0 END
               AS stay FROM {{orders}})"""

CLAIMS = """
SELECT concat('SYN-C', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-',
              date_format(l_shipdate, 'yyyyMMdd')) AS claim_id,
       concat('SYN-E', l_orderkey) AS encounter_id, concat('SYN-M', o_custkey) AS member_id,
       concat('SYN-P', o_custkey) AS patient_id,
       CASE WHEN o_orderpriority = '2-HIGH' THEN 'FACILITY' ELSE 'PROFESSIONAL' END AS claim_type,
       CAST(l_shipdate AS DATE) AS service_date, allowed + allowed AS billed_amount,
       allowed AS allowed_amount,
       CASE WHEN l_returnflag = 'R' THEN allowed - liability ELSE 0 END AS paid_amount,
       liability AS member_liability,
       CASE l_returnflag WHEN 'A' THEN 'DENIED' WHEN 'R' THEN 'PAID' ELSE 'PENDING' END
         AS claim_status,
       get(array('PRIOR_AUTH_MISSING', 'NOT_MEDICALLY_NECESSARY', 'OUT_OF_NETWORK'),
           l_linenumber % 4 - 1) AS denial_reason,
       CASE WHEN o_orderpriority = '2-HIGH' THEN concat('DRG', l_partkey % 111 + 190) END
         AS drg_code
FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS allowed,
             CAST(l_quantity AS DECIMAL(18,2)) AS liability FROM {lineitem})
JOIN {orders} ON l_orderkey = o_orderkey"""

# Every line is a diagnosis; the first line of one order in four is an active one, or everyone would
# reach the comorbidity cap.
DIAGNOSES = """
SELECT concat('SYN-P', o_custkey) AS patient_id,
       CASE p_type WHEN 'ECONOMY' THEN 'I50.9' WHEN 'LARGE' THEN 'E11.9' WHEN 'MEDIUM' THEN 'N18.4'
            WHEN 'PROMO' THEN 'J44.1' WHEN 'STANDARD' THEN 'I10' WHEN 'SMALL' THEN 'Z79.4' END
         AS icd10_code,
       p_name AS diagnosis_description, CAST(o_orderdate AS DATE) AS onset_date,
       p_size % 3 AS charlson_weight, CAST(p_size % 3 > 0 AS INT) AS hcc_flag,
       CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 AND l_orderkey % 4 = 0 THEN 'active'
            ELSE 'resolved' END AS clinical_status
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey"""

# Every line is a medication; the second line of one order in three may still be taken.
MEDICATIONS = """
SELECT concat('SYN-P', o_custkey) AS patient_id, concat('RX-', l_partkey) AS rx_id,
       p_name AS medication_name,
       CASE p_type WHEN 'ECONOMY' THEN 'ARNI' WHEN 'SMALL' THEN 'MRA'
            WHEN 'LARGE' THEN 'SGLT2 inhibitor' WHEN 'MEDIUM' THEN 'biguanide'
            WHEN 'PROMO' THEN 'loop diuretic' WHEN 'STANDARD' THEN 'statin' END AS drug_class,
       CAST(l_shipdate AS DATE) AS start_date,
       CAST(l_partkey % 3 * 30 + 30 AS INT) AS days_supply, CAST(l_suppkey % 6 AS INT) AS refills,
       CAST(35 + l_partkey % 66 AS DECIMAL(6,2)) / 100 AS adherence_pdc,
       CAST(l_returnflag <> 'R' AND l_linenumber = 2 AND l_orderkey % 3 = 0 AS INT) AS active_flag
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey"""

LABS = """
SELECT concat('SYN-P', user_id) AS patient_id,
       CASE event_type WHEN 'click' THEN '4548-4' WHEN 'error' THEN '2160-0'
            WHEN 'view' THEN '33762-6' WHEN 'purchase' THEN '2823-3' WHEN 'signup' THEN '718-7' END
         AS loinc_code,
       CASE event_type WHEN 'click' THEN 'Hemoglobin A1c' WHEN 'error' THEN 'Creatinine, serum'
            WHEN 'view' THEN 'NT-proBNP' WHEN 'purchase' THEN 'Potassium, serum'
            WHEN 'signup' THEN 'Hemoglobin' END AS test_name,
       'unit' AS unit, value / 10 AS result_value, 0.1 AS ref_low, 10 AS ref_high,
       CAST(value > 100 AS INT) AS abnormal_flag, CAST(ts AS DATE) AS collected_date
FROM {events}"""

ED_VISITS = """
SELECT concat('SYN-P', o_custkey) AS patient_id, CAST(o_orderdate AS DATE) AS ed_visit_date,
       'unspecified' AS chief_complaint, CAST(o_orderkey % 5 = 0 AS INT) AS admitted_flag
FROM {orders} WHERE o_orderpriority = '1-URGENT'"""

# Each document as a discharge note holding its whole text. Three notes go to one patient; one note
# in ten has no header at all and one in ten no document id.
NOTES = r"""
SELECT name AS file_name, concat('stage/', name) AS stage_path,
       concat(
         CASE WHEN doc_id % 10 = 0 THEN ''
              WHEN doc_id % 10 = 1 THEN concat('# Clinical note\n\n', people, '\n')
              ELSE concat('# Discharge Summary (SYNTHETIC)\n\n**Document ID:** DS-SYN-E', doc_id,
                          '\n', people, '**Facility:** Facility ', doc_id % 3, '\n\n') END,
         '## Hospital Course\n', text,
         '\n\n## Care Gaps and Follow-up Plan\n- Follow-up with ',
         get(array('cardiology', 'primary care', 'nephrology', 'pulmonology'),
             CAST(n_chars % 4 AS INT)),
         ' within ', (n_chars % 3 + 1) * 7, ' days.\n- Barriers documented: ',
         get(array('transportation', 'medication cost concerns',
                   'lives alone, limited caregiver support', 'no barriers identified'),
             CAST(least(n_chars % 20, 3) AS INT)),
         '.\n\n## Safety Notes\n',
         get(array('No adverse drug events during admission.',
                   'Mild hypotension after dose increase; dose reduced and tolerated.',
                   'Transient hyperkalemia after therapy start; resolved with counseling.',
                   'Reported dizziness after dose increase; follow-up negative.'),
             CAST(n_chars % 4 AS INT)), '\n') AS doc_text
FROM (SELECT *, concat(CASE WHEN doc_id % 10 = 0 THEN 'scan_' ELSE 'discharge_' END, 'SYN-E',
                       doc_id, '.md') AS name,
             concat('**Patient ID:** SYN-P', doc_id - doc_id % 3, '   **Encounter ID:** SYN-E',
                    doc_id, '\n') AS people
      FROM {documents})"""

# Each web page as an institutional document in one of four layouts: full header; header without
# owner; no header, the date in a sentence; header with a malformed date.
PAGE_DOCUMENTS = r"""
SELECT name AS file_name, concat('stage/', name) AS stage_path,
       concat('# ', CASE WHEN page_id % 4 = 2 THEN 'Policy ' ELSE '' END, coalesce(title, ''),
              '\n\n',
              CASE page_id % 4
                WHEN 0 THEN concat(ident, '**Owner:** Owner ', page_id % 7,
                                   '\n**Effective Date:** 2026-01-01\n')
                WHEN 1 THEN concat(ident, '**Effective Date:** 2026-02-01\n')
                WHEN 2 THEN 'This policy is effective from 2026-03-01 on.\n'
                ELSE concat(ident, '**Effective Date:** soon\n') END,
              '\n## Content\n', body_text) AS doc_text
FROM (SELECT *, concat('page_', page_id, '.md') AS name,
             concat('**Document ID:** PG-', page_id, '\n**Document Type:** ',
                    get(array('UTILIZATION_POLICY', 'REGULATORY_BULLETIN', 'QUALITY_MEASURE'),
                        CAST(page_id % 3 AS INT)), '\n') AS ident
      FROM {page_texts})"""

# Events as logged answers, the event type as the asking role.
AUDIT_LOG = """
SELECT concat('A', event_id) AS audit_id, CAST(ts AS TIMESTAMP) AS asked_at,
       concat('user', user_id) AS asked_by, event_type AS asked_role,
       get(array('clinic', 'acuity', 'LOB', 'heart  failure', 'why denied', 'average LOS', 'cost',
                 'region', 'panel', 'Policy', 'readmit rate', 'not a known term'), k % 12)
         AS question,
       array_repeat('label', k % 5) AS citations, value > 50 AS grounded,
       floor(value * 10) AS latency_ms
FROM (SELECT *, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events})"""

# Assistant turns as answers to the golden questions, with a judge verdict from the labels:
# malformed where there is no label, a key missing where the label says toxic.
EVAL_RUNS = """
SELECT concat('run-', conv_id % 4) AS run_id,
       CAST(date_add(DATE '2026-01-01', CAST(conv_id % 300 AS INT)) AS TIMESTAMP_NTZ) AS run_at,
       concat('Q', lpad(CAST(conv_id % 12 + 1 AS STRING), 2, '0')) AS qid, text AS answer_text,
       CASE turn % 3 WHEN 0 THEN array('RegulatoryDocs', 'PatientAnalytics')
            WHEN 1 THEN array('PatientAnalytics') ELSE array('ClinicalNotes', 'EvidencePack') END
         AS tools_observed,
       array(concat('DS-SYN-E', conv_id, ' — Safety Notes (chunk ', turn, ')'),
             concat('claim SYN-C', conv_id)) AS citations_observed,
       CAST(length(text) AS BIGINT) AS latency_ms, 'v1' AS agent_version,
       CASE WHEN quality IS NULL THEN 'no verdict' ELSE concat(
         '{{"grounding":', quality * 5, ',"citation_quality":"', turn % 6, '"',
         CASE WHEN toxic = 1 THEN '' ELSE ',"refusal_correctness":5' END,
         ',"completeness":"', CASE WHEN turn % 4 = 0 THEN 'unsure' ELSE '4' END, '"}}') END
         AS judge_json
FROM {conversations} LEFT JOIN {labels} ON conv_id = doc_id WHERE role = 'assistant'"""

EXTRACT_SQL = {"patients": PATIENTS, "members": MEMBERS, "encounters": ENCOUNTERS,
               "claims": CLAIMS, "diagnoses": DIAGNOSES, "medications": MEDICATIONS, "labs": LABS,
               "ed_visits": ED_VISITS}


# Columns of the source tables, given so that no job runs to read them from the files.
SOURCE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _query(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """A statement over the source tables it names in braces."""
    named = {name for _, name, _, _ in Formatter().parse(sql) if name}
    return spark.sql(sql, **{name: table(spark, folder, name) for name in sorted(named)})


class Extracts(Mapping):
    """The structured tables by name, each planned when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder, self._made = spark, folder, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            rows = _query(self._spark, self._folder, EXTRACT_SQL[name])
            self._made[name] = conform(rows, EXTRACTS[name])
        return self._made[name]

    def __iter__(self):
        return iter(EXTRACT_SQL)

    def __len__(self) -> int:
        return len(EXTRACT_SQL)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Discharge notes and institutional documents."""
    pages = spark.sql(PAGE_DOCUMENTS, page_texts=parse_html(table(spark, folder, "pages")))
    return _query(spark, folder, NOTES).unionByName(pages)


class BoundPanel(Panel):
    """A panel over the driver's tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder
        self.extracts, self.as_of = Extracts(spark, folder), AS_OF
        self.stored, self.los_basis = None, "max"

    @cached_property
    def documents(self) -> DataFrame:
        return documents(self._spark, self._folder)


def panel(spark: SparkSession, folder: str) -> Panel:
    return BoundPanel(spark, folder)


def audit_log(spark: SparkSession, folder: str) -> DataFrame:
    return _query(spark, folder, AUDIT_LOG)


def eval_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _query(spark, folder, EVAL_RUNS)


def centroids(spark: SparkSession, folder: str, width: int = 64) -> DataFrame:
    """Query vectors: the mean embedding of every label, one hash aggregate over the table."""
    means = ", ".join(f"avg(CAST(embedding[{i}] AS DOUBLE))" for i in range(width))
    return _query(spark, folder, f"SELECT label, array({means}) AS query_vector "
                                 "FROM {embeddings} GROUP BY label")
