"""Documents: metadata, section chunks, narrative signals. No Python runs on the rows and nothing
shuffles: each document is handled whole, in its own row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panel360.functions import regex_group, to_int_rounded

# Header-field patterns of the document layout.
HEADER_PATTERNS = {
    "doc_id": r"\*\*Document ID:\*\*\s*([^\n]+)",
    "doc_type": r"\*\*Document Type:\*\*\s*([^\n]+)",
    "owner": r"\*\*Owner:\*\*\s*([^\n]+)",
    "effective": r"\*\*Effective Date:\*\*\s*([0-9]{4}-[0-9]{2}-[0-9]{2})",
    "patient": r"\*\*Patient ID:\*\*\s*(SYN-P[0-9]+)",
    "encounter": r"\*\*Encounter ID:\*\*\s*(SYN-E[0-9A-F]+)",
    "title": r"^#\s+([^\n]+)"}
# Document types.
DISCHARGE = "DISCHARGE_SUMMARY"
UNKNOWN_TYPE = "UNKNOWN"
DEFAULT_OWNER = "Synthetic Health System"
# Second rule set, for layouts without the header block: words of the title that give the type, in
# order of precedence, and looser forms of the owner and the date.
TITLE_TYPES = ((r"discharge", DISCHARGE), (r"bulletin|regulat", "REGULATORY_BULLETIN"),
               (r"label|safety", "DRUG_SAFETY_LABEL"), (r"measure|quality", "QUALITY_MEASURE"),
               (r"policy|authori[sz]ation", "UTILIZATION_POLICY"))
LOOSE_TITLE = r"(?i)^\s*title:[ \t]*([^\n]+)"
LOOSE_ID = r"(?i)\bdocument (?:id|number|no\.)[ \t]*:?[ \t]*([A-Z][A-Z0-9-]*[0-9][A-Z0-9-]*)"
LOOSE_OWNER = r"(?i)\b(?:issued by|owned by|publisher:)[ \t]+([^\n.;]+)"
LOOSE_DATE = r"(?i)effective[^0-9\n]{0,40}([0-9]{4}-[0-9]{2}-[0-9]{2})"
# Phrases of the discharge-note layout.
BARRIER = r"Barriers documented:\s*([^\n]+?)\.(?:\n|$)"
FOLLOWUP_DAYS = r"Follow-up with [^\n]+? within ([0-9]+) days"
FOLLOWUP_SPECIALTY = r"Follow-up with ([^\n]+?) within [0-9]+ days"
SAFETY_NOTE = r"\n## Safety Notes[ \t]*\n+([^\n]+)"
SECTION_HEADING = r"##\s+([^\n]+)"
CHUNK_SIZE, CHUNK_OVERLAP = 900, 150


def _title_type(title: Column) -> Column:
    word, kind = TITLE_TYPES[0]
    rule = F.when(title.rlike(f"(?i){word}"), kind)
    for word, kind in TITLE_TYPES[1:]:
        rule = rule.when(title.rlike(f"(?i){word}"), kind)
    return rule


def _evaluated_once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """`keep` plus `columns`, the latter through a one-row generator. Later filters and projections
    then refer to finished values; as plain aliases the patterns would be copied into each of
    them and run again."""
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))


def doc_metadata(raw: DataFrame, default_owner: str = DEFAULT_OWNER,
                 keep: Sequence[str] = ()) -> DataFrame:
    """Header fields by pattern, then by the second rule set for documents that lack an id, a type
    or a date, then by file name. `extraction_path` says whether the second set was consulted.
    `keep` names further columns of the input to hand on."""
    text, source = F.col("doc_text"), ["file_name", "stage_path", "doc_text", *keep]
    header = {f"{name}_rx": regex_group(text, pattern)
              for name, pattern in HEADER_PATTERNS.items()}
    found = _evaluated_once(raw, source, header)
    partial = (F.col("doc_id_rx").isNull() | F.col("doc_type_rx").isNull()
               | F.col("effective_rx").isNull())

    def second(pattern: str) -> Column:
        return F.when(F.col("_partial"), regex_group(text, pattern))

    titled = _evaluated_once(found.withColumn("_partial", partial),
                             [*source, *header, "_partial"],
                             {"title": F.coalesce("title_rx", second(LOOSE_TITLE))})
    by_name = F.when(F.col("file_name").ilike("discharge%"), DISCHARGE).otherwise(UNKNOWN_TYPE)
    by_title = F.when(F.col("_partial"), _title_type(F.col("title")))
    return titled.select(
        F.coalesce("doc_id_rx", second(LOOSE_ID),
                   F.concat(F.lit("DS-"), F.coalesce("encounter_rx", "file_name"))).alias("doc_id"),
        "file_name", "stage_path", F.col("title").alias("doc_title"),
        F.coalesce("doc_type_rx", by_title, by_name).alias("doc_type"),
        F.coalesce("owner_rx", second(LOOSE_OWNER), F.lit(default_owner)).alias("issuing_owner"),
        F.try_to_date(F.coalesce("effective_rx", second(LOOSE_DATE)), "yyyy-MM-dd")
        .alias("effective_date"),
        F.col("patient_rx").alias("patient_id"), F.col("encounter_rx").alias("encounter_id"),
        F.when(F.col("patient_rx").isNotNull(), "PATIENT_SPECIFIC").otherwise("INSTITUTIONAL")
        .alias("scope"),
        F.length(text).alias("char_count"),
        F.when(F.col("_partial"), "REGEX+RULES").otherwise("REGEX").alias("extraction_path"),
        "doc_text", *keep)


def _section_pieces(section: Column, size: int, overlap: int) -> Column:
    """A section as pieces of at most `size` characters. A section that fits is one piece. A longer
    one is cut behind white space (inside a word only when the word alone is too long) and every
    piece after the first starts with up to `overlap` characters of whole words of the one before,
    so the pieces together hold the whole section."""
    step = size - overlap
    cuts = F.regexp_extract_all(
        section, F.lit(rf"(?s)(.{{1,{step - 1}}}(?:[ \n\t\r]|\z)|.{{1,{step}}})"), F.lit(1))
    tail = r"(?s)[ \n\t\r](.+)\z"
    before = F.concat(F.array(F.lit("")), cuts)
    # `before` is one longer than `cuts`; its last pair has no piece and drops out as NULL.
    joined = F.zip_with(cuts, before, lambda piece, prior: F.concat(
        F.regexp_extract(F.right(prior, F.lit(overlap)), tail, 1), piece))
    return F.when(F.length(section) <= size, F.array(section)).otherwise(joined)


def doc_chunks(metadata: DataFrame, size: int = CHUNK_SIZE,
               overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks that never cross a section. Every chunk of a section carries its heading, so a
    citation names the section also for the later pieces of a long one."""
    if not 0 < overlap < size <= 1000:
        raise ValueError("need 0 < overlap < size <= 1000")
    sections = F.split("doc_text", r"\n(?=## )")

    def cut(section: Column) -> Column:
        heading = F.coalesce(F.when(section.startswith("## "),
                                    regex_group(section, SECTION_HEADING)), F.lit("Header"))
        return F.transform(_section_pieces(section, size, overlap),
                           lambda piece: F.struct(heading.alias("section_heading"),
                                                  piece.alias("chunk_text")))

    pieces = F.filter(F.flatten(F.transform(sections, cut)),
                      lambda piece: F.length(piece["chunk_text"]) > 0)
    keep = ("doc_id", "file_name", "doc_title", "doc_type", "issuing_owner", "effective_date",
            "patient_id", "encounter_id", "scope")
    rows = metadata.select(*keep, F.posexplode(pieces).alias("chunk_index", "_piece"))
    return rows.select(
        *keep, "chunk_index", F.col("_piece.chunk_text").alias("chunk_text"),
        F.col("_piece.section_heading").alias("section_heading"),
        citation_label(F.col("doc_id"), F.col("_piece.section_heading"), F.col("chunk_index"))
        .alias("citation_label"))


def citation_label(doc_id: Column, heading: Column, index: Column) -> Column:
    return F.concat(doc_id, F.lit(" — "), heading, F.lit(" (chunk "), index, F.lit(")"))


def doc_signals(metadata: DataFrame) -> DataFrame:
    """Narrative signals of discharge notes: only the phrasings above are understood; a note that
    words them otherwise yields NULL."""
    text = F.col("doc_text")
    notes = metadata.filter((F.col("doc_type") == DISCHARGE) & F.col("patient_id").isNotNull())
    return _evaluated_once(notes, ["doc_id", "patient_id", "encounter_id"], {
        "adverse_event": regex_group(text, SAFETY_NOTE),
        "barrier_to_care": regex_group(text, BARRIER),
        "followup_days": regex_group(text, FOLLOWUP_DAYS),
        "followup_specialty": regex_group(text, FOLLOWUP_SPECIALTY)})


def safety_flags(signals: DataFrame) -> DataFrame:
    """Typed signals with the two flags; empty text is no barrier and no event."""
    barrier = F.upper(F.coalesce("barrier_to_care", F.lit("NONE")))
    event = F.upper(F.coalesce("adverse_event", F.lit("NONE")))
    return signals.select(
        "doc_id", "patient_id", "encounter_id", "adverse_event", "barrier_to_care",
        to_int_rounded(F.col("followup_days")).alias("followup_days"), "followup_specialty",
        (~barrier.isin("NONE", "NO BARRIERS IDENTIFIED", "")).alias("has_barrier"),
        (~event.like("NO ADVERSE%") & ~event.isin("NONE", "")).alias("has_adverse_event"))


def doc_type_summary(chunks: DataFrame, approximate: bool = False) -> DataFrame:
    """Documents and chunks per type; the distinct count is exact unless asked otherwise."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return chunks.groupBy("doc_type").agg(distinct(F.col("doc_id")).alias("docs"),
                                          F.count("*").alias("chunks"))


def linked_documents(chunks: DataFrame) -> DataFrame:
    """The documents of each patient."""
    return (chunks.filter(F.col("patient_id").isNotNull())
            .select("patient_id", "doc_id", "doc_title", "doc_type", "effective_date").distinct())
