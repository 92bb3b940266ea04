"""Word lists and the name bank, each replaceable by a file or a table of one's own."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# The words of each category that a scan reports.
KEYWORDS = {
    "medical": (
        "ADHD", "autism", "ASD", "dyslexia", "dyspraxia", "dyscalculia", "epilepsy", "diabetes", "asthma", "anxiety", "depression", "OCD", "PTSD", "anorexia", "bulimia",
        "self-harm", "wheelchair", "hearing aid", "insulin", "inhaler", "EpiPen", "medication", "diagnosis", "diagnosed", "therapy", "therapist", "counselling", "counsellor",
        "psychiatrist", "psychologist", "speech therapy", "occupational therapy", "physiotherapy", "CAMHS referral", "hospital", "clinic", "consultant", "operation", "surgery",
        "sensory", "prosthetic", "catheter", "seizure", "allergy", "anaphylaxis", "mental health", "eating disorder", "chronic fatigue", "ME", "fibromyalgia", "Tourette",
        "cerebral palsy", "Down syndrome", "spina bifida", "muscular dystrophy", "cystic fibrosis", "sickle cell", "bipolar", "schizophrenia", "EHCP", "EHC plan", "statement",
        "statemented", "SEN support", "School Action", "School Action Plus", "individual education plan", "IEP", "one-to-one support", "LSA", "teaching assistant support",
        "reader", "scribe", "extra time", "access arrangements", "modified paper",
    ),
    "safeguarding": (
        "social services", "social worker", "child protection", "safeguarding", "MASH", "LADO", "Section 47", "Section 17", "looked after", "looked-after", "LAC", "care order",
        "foster", "fostering", "foster carer", "children's home", "residential care", "adoption", "adopted", "kinship", "child in need", "CIN", "early help", "TAF",
        "team around the family", "MARAC", "domestic violence", "domestic abuse", "DV", "abuse", "neglect", "neglected", "FGM", "exploitation", "CSE", "CCE", "county lines",
        "trafficking", "radicalisation", "Prevent", "disclosure", "allegation", "investigation", "police", "arrested", "custody", "court", "magistrate", "youth offending", "YOT",
        "referral", "multi-agency", "core group", "case conference", "child protection plan", "CPP", "excluded", "exclusion", "fixed term exclusion", "permanent exclusion",
        "managed move", "alternative provision", "PRU", "EOTAS", "elective home education", "EHE", "missing", "absent", "CME", "fabricated illness",
    ),
    "family": (
        "mother", "father", "mum", "dad", "mummy", "daddy", "parent", "parents", "guardian", "step-mother", "step-father", "stepmother", "stepfather", "step-mum", "step-dad",
        "stepmum", "stepdad", "brother", "sister", "sibling", "half-brother", "half-sister", "twin", "triplet", "aunt", "uncle", "auntie", "grandmother", "grandfather", "grandma",
        "grandad", "granddad", "nan", "nana", "grandparent", "cousin", "nephew", "niece", "carer", "family", "partner", "husband", "wife", "son", "daughter", "foster carer",
        "foster parent", "kinship carer", "next of kin",
    ),
}

# What a rare value of a category may be generalised to.
GENERALISATIONS = {
    "SEN": {"EHCP": "SEN: Yes", "EHC plan": "SEN: Yes", "School Action Plus": "SEN: Yes", "School Action": "SEN: Yes", "SA+": "SEN: Yes", "SA": "SEN: Yes", "K": "SEN: Yes", "E": "SEN: Yes",
            "SEN Support": "SEN: Yes", "No SEN": "SEN: No", "None": "SEN: No", "N": "SEN: No"},
    "PP": {"FSM": "Disadvantaged: Yes", "Pupil Premium": "Disadvantaged: Yes", "PP": "Disadvantaged: Yes", "FSM6": "Disadvantaged: Yes", "Ever 6 FSM": "Disadvantaged: Yes",
           "Service Child": "Disadvantaged: Yes", "Yes": "Disadvantaged: Yes", "No": "Disadvantaged: No", "N": "Disadvantaged: No"},
    "LAC": {"Looked After Child": "Additional support: Yes", "LAC": "Additional support: Yes", "Previously LAC": "Additional support: Yes", "PLAC": "Additional support: Yes",
            "Child Protection Plan": "Additional support: Yes", "CPP": "Additional support: Yes", "Child in Need": "Additional support: Yes", "CIN": "Additional support: Yes",
            "No": "Additional support: No", "N": "Additional support: No"},
    "EAL": {"EAL": "Additional support: Yes", "Yes": "Additional support: Yes", "A": "Additional support: Yes", "B": "Additional support: Yes", "C": "Additional support: Yes",
            "D": "Additional support: Yes", "E": "Additional support: Yes", "N": "Additional support: No", "No": "Additional support: No"},
    "medical": {"ADHD": "Medical: Yes", "Autism": "Medical: Yes", "ASD": "Medical: Yes", "Dyslexia": "Medical: Yes", "Dyspraxia": "Medical: Yes", "Epilepsy": "Medical: Yes",
                "Diabetes": "Medical: Yes", "Asthma": "Medical: Yes", "No": "Medical: No", "None": "Medical: No"},
}

_ONSETS = ("B", "Br", "C", "D", "Dr", "F", "G", "H", "J", "K", "L", "M", "N", "P", "R", "S", "T", "Tr", "V", "W")
_CORES = ("a", "e", "i", "o", "u")
_ENDS = {"male": ("ric", "lan", "den", "mond", "ton"), "female": ("lina", "rene", "wenna", "dra", "this"), "neutral": ("sky", "ley", "ren", "vi", "quin"), "surnames": ("stead", "holm", "field", "more", "ley")}


def _made(kind: str, n: int) -> list[str]:
    """``n`` names by rule: onset, vowel, ending, in a fixed order that varies the onset first."""
    every = [o + v + e for e in _ENDS[kind] for v in _CORES for o in _ONSETS]
    return every[:n]


def name_bank() -> dict[str, list[str]]:
    """The built-in bank, made by rule; every name is in one list only once."""
    return {"male": _made("male", 250), "female": _made("female", 250), "neutral": _made("neutral", 50), "surnames": _made("surnames", 500)}


def load_names(path: str) -> dict[str, list[str]]:
    """A bank of one's own: JSON with the lists male, female, neutral and surnames."""
    bank = json.loads(Path(path).read_text(encoding="utf-8"))
    return {k: list(bank[k]) for k in ("male", "female", "neutral", "surnames")}


def load_keywords(path: str) -> dict[str, list[str]]:
    """Keyword lists of one's own: JSON with a list per category; what is no list is skipped."""
    words = json.loads(Path(path).read_text(encoding="utf-8"))
    return {k: list(v) for k, v in words.items() if isinstance(v, list)}


def names_table(spark: SparkSession, bank: dict[str, list[str]] | None = None) -> DataFrame:
    """(list, pos, name) of a bank."""
    bank = bank or name_bank()
    return spark.createDataFrame([(k, i, n) for k, v in bank.items() for i, n in enumerate(v)], "list string, pos int, name string")


def generalisations_table(spark: SparkSession, given: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(place, category, value, suggestion) in the order of the lists."""
    rows = [(c, v, s) for c, m in (given or GENERALISATIONS).items() for v, s in m.items()]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, category string, value string, suggestion string")
