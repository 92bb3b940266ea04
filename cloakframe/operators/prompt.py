"""Prompts assembled from templates, answers and anonymised rows."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The instructions and templates.
INSTRUCTIONS = (
    "Always include student ID tokens (e.g. [S01], [S02]) whenever you refer to a student.",
    "Always use each student's full name — never use first name only, initials, or abbreviations.",
    'Use a structured output format: either tables or prefix each student reference with "STUDENT: Name [ID]".',
    "Do not invent or fabricate any student names — only use names exactly as they appear in the data provided.",
    "Copy all student names and ID tokens character-for-character from the data. Do not alter spelling, capitalisation, or spacing.",
)
_TEXT = {"type": "string"}
TEMPLATES = (
    {
        "id": "analyse-class-performance", "name": "Analyse Class Performance",
        "description": "Identify trends, outliers, and intervention groups from anonymised class data. Returns structured JSON for easy review.",
        "tier": "free", "outputFormat": "json", "deanonymiseStrategy": "json",
        "questions": (
            {"id": "subject", "label": "Subject", "type": "text", "placeholder": "e.g. Year 10 Maths", "required": True},
            {"id": "focus", "label": "Analysis focus", "type": "dropdown", "options": ("trends", "intervention", "outliers", "groups"), "required": True},
            {"id": "context", "label": "Additional context", "type": "text", "placeholder": "e.g. Recent mock exam results, focus on PP students", "required": False},
        ),
        "preamble": "Analyse the following {subject} class data. Focus on: {focus}.", "optional": {"context": " Additional context: {context}"},
        "jsonSchema": {
            "type": "object",
            "properties": {
                "groups": {
                    "type": "array",
                    "items": {
                        "type": "object",
                        "properties": {
                            "name": {**_TEXT, "description": "Group label, e.g. 'Needs intervention'"},
                            "students": {
                                "type": "array",
                                "items": {
                                    "type": "object",
                                    "properties": {
                                        "id": {**_TEXT, "description": "Student ID token, e.g. [S01]"}, "name": {**_TEXT, "description": "Full fake name"},
                                        "reason": {**_TEXT, "description": "Why this student is in this group"},
                                    },
                                    "required": ["id", "name", "reason"],
                                },
                            },
                            "recommendation": {**_TEXT, "description": "Suggested action for this group"},
                        },
                        "required": ["name", "students", "recommendation"],
                    },
                },
                "summary": {**_TEXT, "description": "Overall summary of the analysis"},
            },
            "required": ["groups", "summary"],
        },
    },
    {
        "id": "write-report-comments", "name": "Write Report Comments", "description": "Generate individual report comments for each student based on their anonymised data.",
        "tier": "free", "outputFormat": "prose", "deanonymiseStrategy": "id-first",
        "questions": (
            {"id": "subject", "label": "Subject", "type": "text", "placeholder": "e.g. Year 9 English", "required": True},
            {"id": "tone", "label": "Tone", "type": "dropdown", "options": ("formal", "encouraging", "targets"), "required": True},
            {"id": "wordCount", "label": "Approximate word count per comment", "type": "dropdown", "options": ("50", "100", "150"), "required": True},
        ),
        "preamble": "Write individual report comments for each student in the following {subject} class data. Use a {tone} tone. Each comment should be approximately {wordCount} words.",
    },
    {
        "id": "generate-differentiated-questions", "name": "Generate Differentiated Questions",
        "description": "Create tiered questions at multiple difficulty levels, tailored to student groups in the class data.",
        "tier": "free", "outputFormat": "prose", "deanonymiseStrategy": "id-first",
        "questions": (
            {"id": "subjectAndTopic", "label": "Subject and topic", "type": "text", "placeholder": "e.g. GCSE Biology — Photosynthesis", "required": True},
            {"id": "difficultyLevels", "label": "Number of difficulty levels", "type": "dropdown", "options": ("2", "3"), "required": True},
            {"id": "questionsPerLevel", "label": "Questions per level", "type": "dropdown", "options": ("3", "5"), "required": True},
        ),
        "preamble": "Using the following class data, generate differentiated questions for {subjectAndTopic}. Create {difficultyLevels} difficulty levels with {questionsPerLevel} questions per level. Tailor the difficulty to the student groups visible in the data.",
    },
)
SUMMARY = ("id", "name", "description", "tier", "outputFormat", "deanonymiseStrategy")


def list_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(t[k] for k in SUMMARY) for t in TEMPLATES], ", ".join(f"{k} string" for k in SUMMARY))


def get_template(template: str) -> Mapping:
    for t in TEMPLATES:
        if t["id"] == template:
            return t
    raise KeyError(f"no template {template!r}")


def check_answers(template: Mapping, answers: Mapping[str, str]) -> None:
    for q in template["questions"]:
        if q["required"] and answers.get(q["id"]) in (None, ""):
            raise ValueError(f"an answer is missing: {q['label']} ({q['id']})")


def preamble(template: Mapping, answers: Mapping[str, str]) -> str:
    return template["preamble"].format_map(answers) + "".join(v.format_map(answers) for k, v in template.get("optional", {}).items() if answers.get(k))


def frame(template: str, answers: Mapping[str, str]) -> tuple[str, str, str]:
    """What stands before and after the data, and the strategy that restores the answer."""
    t = get_template(template)
    check_answers(t, answers)
    after = ["```", "", "Important instructions:", *(f"{i}. {s}" for i, s in enumerate(INSTRUCTIONS, 1))]
    if "jsonSchema" in t:
        after += ["", "Respond with valid JSON matching this schema:", "```json", json.dumps(t["jsonSchema"], indent=2, ensure_ascii=False), "```"]
    return "\n".join([preamble(t, answers), "", "```csv"]), "\n".join(after), t["deanonymiseStrategy"]


def csv_cell(c):
    """A cell quoted if it holds a delimiter, a quote, a line break or outer spaces."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike(r'[",\r\n]|^\s|\s$'), F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))).otherwise(text)


def csv_text(df: DataFrame, columns: list[str], order: str, cohort: str) -> DataFrame:
    """(cohort, csv): the rows of each cohort, a class sheet, as one CSV text with headings."""
    head = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\n') else c for c in columns)
    line = F.concat_ws(",", *(csv_cell(F.col(f"`{c}`")) for c in columns))
    rows = df.select(F.col(cohort), F.struct(F.col(order).alias("o"), line.alias("line")).alias("r")).groupBy(cohort).agg(F.sort_array(F.collect_list("r")).alias("rs"))
    return rows.select(cohort, F.concat_ws("\r\n", F.lit(head), F.transform("rs", lambda r: r["line"])).alias("csv"))


def assemble(df: DataFrame, template: str, answers: Mapping[str, str], columns: list[str], order: str, cohort: str) -> DataFrame:
    """(cohort, prompt, strategy): one prompt per cohort."""
    before, after, strategy = frame(template, answers)
    return csv_text(df, columns, order, cohort).select(cohort, F.concat_ws("\n", F.lit(before), "csv", F.lit(after)).alias("prompt"), F.lit(strategy).alias("strategy"))
