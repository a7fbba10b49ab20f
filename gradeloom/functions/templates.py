"""Prompts that ask a model for hypotheses: one template per data set and task, as a table whose slots are parsed once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that a template may ask for.
SLOTS = ("TRANSCRIPT",)
SLOT = re.compile(r"\{\{([A-Z_]+)\}\}")
PARTS = "array<struct<text:string,slot:string>>"


def _shape(counts: dict[str, int], doubled: bool) -> str:
    """The JSON that is asked for: a list of so many dots under each key.  ``doubled``: with two braces, as some of the texts have them."""
    lists = ",\n".join(f'  "{key}": [{", ".join(["\"...\""] * n)}]' for key, n in counts.items())
    return ("{{\n" if doubled else "{\n") + lists + ("\n}}" if doubled else "\n}")


def _asked(intro: str, task: str, constraints: list[str], counts: dict[str, int], doubled: bool = True, only: str = "Respond only in JSON:") -> str:
    """Introduction, task, constraints, the JSON asked for, and the transcript."""
    return f"{intro}\n\n{task}\n\nConstraints:\n" + "".join(f"- {c}\n" for c in constraints) + f"\n{only}\n{_shape(counts, doubled)}\n\nTranscript:\n{{{{TRANSCRIPT}}}}\n"


# The texts of the prompts.
_MEANING = "The transcript represents the meaning conveyed by the audio and is provided only for annotation."
_NLI = "Task:\nGenerate hypotheses for a Spoken Natural Language Inference task.\n\nGenerate:\n"
_THREE = _NLI + "- Three entailed hypotheses\n- Three neutral hypotheses\n- Three contradictory hypotheses"
_ONE = _NLI + "- one entailed hypothesis\n- one neutral hypothesis\n- one contradictory hypothesis"
_SHORT = ["Do not quote the transcript.", "Do not use explicit negation.", "Each statement must be one sentence."]
_NLI_KEYS, _CONSISTENT, _PLAUSIBLE = ("entailment", "neutral", "contradiction"), ("consistent", "inconsistent"), ("plausible", "implausible")
_AFRI = "You are given a transcript of a spoken audio recording."
_AFRI_NLI = f"You are given a transcript of a spoken audio recording from a general-purpose speech dataset.\n\n{_MEANING}"
_AFRI_NLI_RULES = ["Hypotheses should reflect semantic understanding rather than literal wording.", "Do not quote or closely paraphrase the transcript.", "Do not use explicit negation.", "Each hypothesis must be one sentence."]
_AFRI_GROUNDED = ["Statements should be grounded in the general meaning of the speech.", *_SHORT]
_AFRI_EVERYDAY = ["Plausibility may rely on everyday commonsense.", *_SHORT]
_MEDICAL_SYSTEM = "You are a helpful assistant with expertise in spoken medical communication and semantic inference."
_PARLIAMENT_SYSTEM = "You are a helpful assistant with expert knowledge in spoken language understanding, discourse analysis, and semantic inference in institutional settings such as parliamentary or legislative proceedings."
_ACCENT = """Accent-Conditioned Semantic Drift Hypothesis Generation
(Fairness & Robustness Under Accent Variation)
You are evaluating semantic stability in spoken language understanding.

You are given a verbatim transcript of a short spoken audio recording.
The transcript represents the meaning of the audio and is provided only for annotation.

IMPORTANT:
This task is designed to test whether models infer DIFFERENT meanings
from similar short utterances spoken with different accents or pronunciations.

TASK:
Generate hypotheses that should be interpreted IDENTICALLY
regardless of the speaker’s accent, pronunciation, or speaking style.

Generate the following:

1) ACCENT-INVARIANT hypotheses (4 items)
   – Statements whose truth should NOT depend on accent or speaker identity.
   – These should rely only on the semantic content of the utterance.

2) ACCENT-SENSITIVE LURE hypotheses (4 items)
   – Statements that models might incorrectly infer due to accent,
     pronunciation, or training bias.
   – These should NOT be inferable from the transcript alone.

CONSTRAINTS (must follow strictly):
- Do NOT quote or closely paraphrase the transcript.
- Do NOT assume speaker nationality, ethnicity, gender, age, or location.
- Do NOT assume intent or topic unless explicitly supported.
- Each hypothesis must be one complete sentence.
- Avoid explicit negation terms such as “no,” “not,” “never,” or “without.”

GOAL:
Accent-sensitive lures should test whether a model:
- Assigns social or institutional roles
- Infers geographic or cultural background
- Injects domain meaning
- Changes interpretation due to accent alone

OUTPUT FORMAT (JSON only):

{
  "accent_invariant": [
    "...",
    "...",
    "...",
    "..."
  ],
  "accent_sensitive_lures": [
    "...",
    "...",
    "...",
    "..."
  ]
}

TRANSCRIPT:
{{TRANSCRIPT}}
"""
_RESTRAINT = """Semantic Restraint / Over-Inference Hypothesis Generation
(Hallucination & Overgeneralization Evaluation)
You are a careful evaluator of spoken language meaning.

You are given a verbatim transcript of a very short spoken audio recording.
The transcript represents all meaningful semantic information available from the audio.
The transcript is provided only for annotation purposes.

This audio contains LIMITED semantic content.
Your task is to generate hypotheses that test whether a model can
correctly WITHHOLD inference when the audio does not provide enough evidence.

TASK:
Generate hypotheses for evaluating semantic restraint and hallucination.

Generate the following:

1) SUPPORTED hypotheses (2 items)
   – Statements that are clearly supported by the meaning of the audio.
   – These should be minimal and cautious.

2) UNSUPPORTED hypotheses (6 items)
   – Statements that may sound reasonable in general speech datasets,
     but are NOT supported by the meaning of this audio.
   – These hypotheses should tempt a model to over-infer.

CONSTRAINTS (must follow strictly):
- Do NOT quote or closely paraphrase the transcript.
- Do NOT describe what the speaker “says” or “mentions.”
- Do NOT add roles, topics, locations, intent, emotions, or domains
  unless they are explicitly supported.
- Each hypothesis must be one complete sentence.
- Avoid explicit negation terms such as “no,” “not,” “never,” or “without.”

GOAL:
Unsupported hypotheses should test for:
- Invented topics
- Invented intent
- Invented social roles
- Invented domains (e.g., politics, health, finance)
- Invented situational context

OUTPUT FORMAT (JSON only):

{
  "supported": [
    "...",
    "..."
  ],
  "unsupported": [
    "...",
    "...",
    "...",
    "...",
    "...",
    "..."
  ]
}

TRANSCRIPT:
{{TRANSCRIPT}}
"""
_JSON = " Always return strictly valid JSON."
#: (data set, task, form): what the system says, and the template.
TEMPLATES = {
    ("afrispeech200", "nli", "multi"): ("You analyze spoken general-purpose speech for semantic inference." + _JSON, _asked(_AFRI_NLI, _THREE, _AFRI_NLI_RULES, dict.fromkeys(_NLI_KEYS, 3), False)),
    ("afrispeech200", "nli", "single"): ("You analyze spoken general-purpose speech for semantic inference." + _JSON, _asked(_AFRI_NLI, _ONE, _AFRI_NLI_RULES, dict.fromkeys(_NLI_KEYS, 1), False)),
    ("afrispeech200", "consistency", "multi"): ("You assess semantic consistency from general spoken transcripts." + _JSON, _asked(_AFRI, "Task:\nGenerate four statements:\n- Two semantically consistent with the audio.\n- Two semantically inconsistent with the audio.", _AFRI_GROUNDED, dict.fromkeys(_CONSISTENT, 2), False)),
    ("afrispeech200", "consistency", "single"): ("You assess semantic consistency from general spoken transcripts." + _JSON, _asked(_AFRI, "Task:\nGenerate two statements:\n- one semantically consistent with the audio.\n- one semantically inconsistent with the audio.", _AFRI_GROUNDED, dict.fromkeys(_CONSISTENT, 1), False)),
    ("afrispeech200", "plausibility", "multi"): ("You judge everyday plausibility from general spoken transcripts." + _JSON, _asked(_AFRI, "Task:\nGenerate four statements:\n- Two plausible given the content and context of the audio.\n- Two implausible given the content and context.", _AFRI_EVERYDAY, dict.fromkeys(_PLAUSIBLE, 2), False)),
    ("afrispeech200", "plausibility", "single"): ("You judge everyday plausibility from general spoken transcripts." + _JSON, _asked(_AFRI, "Task:\nGenerate two statements:\n- one plausible given the content and context of the audio.\n- one implausible given the content and context.", _AFRI_EVERYDAY, dict.fromkeys(_PLAUSIBLE, 1), False)),
    ("general", "consistency", "multi"): ("You assess semantic consistency for short general-domain speech." + _JSON, _asked("You are given a transcript of a short spoken audio recording from a general-domain dataset.", "Task:\nGenerate four statements:\n- Two that are semantically consistent with the audio.\n- Two that are semantically inconsistent with the audio.", ["Statements should remain high-level and avoid specific assumptions.", *_SHORT], dict.fromkeys(_CONSISTENT, 2))),
    ("general", "plausibility", "multi"): ("You judge general commonsense plausibility for short spoken transcripts." + _JSON, _asked("You are given a transcript of a short spoken audio recording.", "Task:\nGenerate four statements:\n- Two plausible statements.\n- Two implausible statements.", ["Statements should rely on general commonsense.", "Avoid adding unnecessary detail.", *_SHORT], dict.fromkeys(_PLAUSIBLE, 2))),
    ("medical", "nli", "multi"): (_MEDICAL_SYSTEM + _JSON, _asked(f"{_MEDICAL_SYSTEM}\n\nYou are given a transcript of a spoken medical audio recording. {_MEANING[:-1]} purposes.", _THREE, ["Hypotheses must focus on medical facts, procedures, or advice.", "Do not quote or closely paraphrase the transcript.", "Do not use explicit negation terms.", "Each hypothesis must be one sentence."], dict.fromkeys(_NLI_KEYS, 3))),
    ("medical", "consistency", "multi"): ("You are a medical assistant generating semantic consistency annotations." + _JSON, _asked("You are given a transcript of a spoken medical audio recording.", "Task:\nGenerate four text statements:\n- Two that are semantically consistent with the audio.\n- Two that are semantically inconsistent with the audio.", ["Statements should concern medical knowledge, procedures, or guidance.", "Avoid quoting the transcript.", *_SHORT[1:]], dict.fromkeys(_CONSISTENT, 2))),
    ("medical", "plausibility", "multi"): ("You assess medical plausibility from spoken transcripts." + _JSON, _asked("You are given a transcript of a spoken medical audio recording.", "Task:\nGenerate four statements:\n- Two plausible statements that align with the medical context of the audio.\n- Two implausible statements that are unlikely given the audio context.", ["Plausibility judgments may rely on medical commonsense.", *_SHORT], dict.fromkeys(_PLAUSIBLE, 2))),
    ("parliament", "commonsense", "multi"): ("You infer commonsense implications in parliamentary contexts." + _JSON, _asked("You are given a transcript of a spoken audio recording from a formal parliamentary context.\n\nThe transcript reflects the semantic content conveyed by the audio and is provided only for annotation.", "Task:\nGenerate three commonsense inferences that a typical listener could reasonably make based on shared knowledge of parliamentary procedures and institutional norms, even if these facts are not explicitly stated.", ["Inferences must rely on social or institutional knowledge.", "Do not quote or paraphrase the transcript.", "Do not use explicit negation.", "Each inference must be one sentence."], {"commonsense_inference": 3})),
    ("parliament", "consistency", "multi"): ("You are assisting in the construction of an audio–text semantic consistency dataset." + _JSON, _asked("You are assisting in the construction of an audio–text semantic consistency dataset.\n\nYou are given a transcript of a spoken parliamentary audio recording. The transcript is provided only to determine the meaning conveyed by the audio.", "Task:\nGenerate four text statements:\n- Two statements that are semantically consistent with the audio.\n- Two statements that are semantically inconsistent with the audio.", ["Statements should concern institutional roles, procedures, or formal discourse.", "Do not quote or restate the transcript.", "Do not use explicit negation words.", "Each statement must be one sentence."], dict.fromkeys(_CONSISTENT, 2))),
    ("parliament", "nli", "multi"): (
        _PARLIAMENT_SYSTEM + _JSON,
        _asked(
            f"{_PARLIAMENT_SYSTEM}\n\nYou are given a verbatim transcript of a single spoken audio recording from a formal parliamentary context. The transcript represents the semantic content conveyed by the audio and is provided only for annotation purposes.\n\nUsing the transcript and your knowledge of parliamentary discourse and language use, generate hypotheses for a Spoken Natural Language Inference task.",
            "Instructions:\nGenerate three hypotheses for each category:\n- Entailment: statements that are definitely true given the meaning of the spoken audio.\n- Neutral: statements that might be true but cannot be determined from the audio alone.\n- Contradiction: statements that are definitely false given the meaning of the audio.",
            ["Do not quote or closely paraphrase the transcript.", "Do not state that the speaker “says” or “mentions” something.", "Hypotheses must reflect semantic inference, not surface wording.", "Do not use explicit negation terms such as “no,” “not,” or “never.”", "Each hypothesis must be a single complete sentence."],
            dict.fromkeys(_NLI_KEYS, 3),
            only="Respond only in valid JSON with the structure:",
        ),
    ),
    ("parliament", "intent", "multi"): ("You analyze parliamentary speech intents." + _JSON, _asked("You are given a transcript of a spoken audio recording from a parliamentary or legislative setting.\n\nThe transcript represents the meaning of the spoken audio and is provided only for annotation purposes.", "Task:\nInfer the primary communicative intent of the speaker.\n\nGenerate three intent statements describing what the speaker is trying to accomplish, such as supporting a proposal, providing justification, requesting clarification, or contributing to formal proceedings.", ["Do not quote the transcript.", "Do not describe literal wording.", "Each intent must be expressed as a single sentence."], {"intent": 3})),
    ("afrinames", "accent_drift", "multi"): ("You evaluate semantic stability under accent variation." + _JSON, _ACCENT),
    ("afrinames", "restraint", "multi"): ("You evaluate semantic restraint and hallucination risks in very short spoken transcripts." + _JSON, _RESTRAINT),
}


def parse_slots(template: str, slots: tuple[str, ...] = SLOTS) -> list[tuple[str | None, str | None]]:
    """The template as (text, slot) parts, one of each pair set.  A slot that isn't in ``slots`` is an error.

    A slot is upper-case letters in two braces; other braces are text.
    """
    parts, at = [], 0
    for m in SLOT.finditer(template):
        if m[1] not in slots:
            raise ValueError(f"unknown slot {m[0]}; known are {', '.join(slots)}")
        parts += [(template[at : m.start()], None)] if m.start() > at else []
        parts.append((None, m[1]))
        at = m.end()
    return [*parts, *([(template[at:], None)] if at < len(template) else [])]


def template_table(spark: SparkSession, templates: dict[tuple[str, str, str], tuple[str, str]] = TEMPLATES, slots: tuple[str, ...] = SLOTS) -> DataFrame:
    """(dataset, task, form, system, parts) of the templates; all slots are checked here, before any row is filled."""
    rows = [(*key, system, parse_slots(text, slots)) for key, (system, text) in templates.items()]
    return spark.createDataFrame(rows, f"dataset string, task string, form string, system string, parts {PARTS}")


def fill_parts(parts: Column, slots: dict[str, Column]) -> Column:
    """All parts in one pass, so braces inside a value stay as they are; a null value is empty."""

    def said(part: Column) -> Column:
        out = part["text"]
        for name, value in slots.items():
            out = F.when(part["slot"] == name, F.coalesce(value, F.lit(""))).otherwise(out)
        return out

    return F.array_join(F.transform(parts, said), "")


def generation_prompts(records: DataFrame, templates: DataFrame, form: str = "multi", transcript: str = "transcript") -> DataFrame:
    """Add ``system`` and ``prompt`` to records (dataset, task, transcript): their template with its slots filled.

    Where a pair has no template of ``form``, the one of ``multi`` stands in; a pair without any is an error that names it.
    The table of templates has a row for each pair and form; Spark checks its size before it broadcasts it.
    """
    chosen = templates.filter(F.col("form").isin(form, "multi")).groupBy(F.col("dataset").alias("_dataset"), F.col("task").alias("_task"))
    chosen = chosen.agg(F.max_by(F.struct("system", "parts"), F.when(F.col("form") == form, 1).otherwise(0)).alias("_t"))
    joined = records.drop("system", "prompt").join(chosen, (F.col("dataset") == F.col("_dataset")) & (F.col("task") == F.col("_task")), "left")
    lacking = F.raise_error(F.concat(F.lit("no template for data set "), F.coalesce("dataset", F.lit("null")), F.lit(" and task "), F.coalesce("task", F.lit("null"))))
    prompt = F.when(F.col("_t").isNull(), lacking).otherwise(fill_parts(F.col("_t.parts"), {"TRANSCRIPT": F.col(transcript)}))
    return joined.withColumns({"system": F.col("_t.system"), "prompt": prompt}).drop("_dataset", "_task", "_t")
