"""Prompts, chat messages and in-context-learning overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from .hypotheses import TASK_KEYS, as_list

# The text of the prompts.
CLASSIFY = {
    "nli": "You are given a speech transcript and a statement.\n\nBased only on the transcript, determine whether the statement is:\n- ENTAILMENT\n- CONTRADICTION\n- NEUTRAL\n\nOutput exactly one label:\nENTAILMENT or CONTRADICTION or NEUTRAL\n\nTranscript:\n{transcript}\n\nStatement:\n{hypothesis}\n",
    "consistency": "You are given a speech transcript and a statement.\n\nDetermine whether the statement is consistent with the transcript meaning.\nOutput exactly one label:\nCONSISTENT or INCONSISTENT\n\nTranscript:\n{transcript}\n\nStatement:\n{hypothesis}\n",
    "plausibility": "You are given a speech transcript and a statement.\n\nIs the statement plausible given the transcript?\nOutput exactly one label:\nPLAUSIBLE or IMPLAUSIBLE\n\nTranscript:\n{transcript}\n\nStatement:\n{hypothesis}\n",
    "restraint": "You are given a speech transcript and a statement.\n\nBased only on transcript evidence, determine whether the statement is supported.\nOutput exactly one label:\nSUPPORTED or UNSUPPORTED\n\nTranscript:\n{transcript}\n\nStatement:\n{hypothesis}\n",
    "accent_drift": "You are given a speech transcript and a statement.\n\nDetermine whether the statement is semantically true with respect to transcript content.\nOutput exactly one label:\nTRUE or FALSE\n\nTranscript:\n{transcript}\n\nStatement:\n{hypothesis}\n",
}
AUDIO = {
    "nli": """You are given an audio recording of spoken speech and a text statement.

Based only on the content of the audio, determine whether the statement is:
- Entailed by the audio
- Contradicted by the audio
- Neither entailed nor contradicted by the audio

Do not assume any information not present in the audio.

Respond with one of the following labels only:
ENTAILMENT
CONTRADICTION
NEUTRAL

STATEMENT:
{hypothesis}""",
    "consistency": """You are given an audio recording and a text statement.

Determine whether the text is consistent with the meaning conveyed in the audio.

Respond with one of the following labels only:
CONSISTENT
INCONSISTENT

STATEMENT:
{hypothesis}""",
    "plausibility": """You are given an audio recording and a text statement.

Is the statement plausible given what is heard in the audio?

Respond with:
PLAUSIBLE
IMPLAUSIBLE

STATEMENT:
{hypothesis}""",
    "intent": """You are given an audio recording of spoken speech.

Which of the following best describes the speaker's communicative intent?

Choose the single best answer from the provided options.

OPTIONS:
{options}

Respond with the exact option text only.""",
    "commonsense": """You are given an audio recording of spoken speech.

Based on common knowledge and the content of the audio, answer the following question.

Respond with:
YES
NO

QUESTION:
{hypothesis}""",
    "restraint": """You are given an audio recording of spoken speech and a text statement.

Based only on the content of the audio, determine whether the statement is:
- Supported by the audio
- Not supported by the audio

Do not assume any information not present in the audio.

Respond with one of the following labels only:
SUPPORTED
UNSUPPORTED

STATEMENT:
{hypothesis}""",
    "accent_drift": """You are given an audio recording of spoken speech and a text statement.

Determine whether the statement is true based on the semantic content of the audio, regardless of accent or pronunciation.

Respond with one of the following labels only:
TRUE
FALSE

STATEMENT:
{hypothesis}""",
    "interview_nli": """You are evaluating an audio interview about stuttering and speech experiences.

Listen to what the speaker says in the audio, then determine the relationship between the audio and the following statement.

Classification:
- ENTAILMENT: The statement is supported by what is said in the audio
- CONTRADICTION: The statement contradicts what is said in the audio
- NEUTRAL: The statement is neither supported nor contradicted by the audio

Important:
- Base your answer ONLY on the audio content
- Do not make assumptions beyond what is explicitly stated
- Consider what the speaker actually says about their experiences

Respond with exactly one label:
ENTAILMENT
CONTRADICTION
NEUTRAL

STATEMENT:
{hypothesis}""",
}
LABEL_SENTENCE = "Given the audio, the following statement is {label}: {hypothesis}"
ICL_HEADER = "Use the solved examples below to classify the target pair.\nEach example includes {fields}.\nValid labels: ENTAILMENT, CONTRADICTION, NEUTRAL.\n"
ICL_TRAILER = "Now classify the target pair with one label only.\n"
CYCLE = ["ENTAILMENT", "NEUTRAL", "CONTRADICTION"]
#: Of each in-context variant: whether examples carry the transcript and the hypothesis.
VARIANTS = {"audio_only": (False, False), "audio_hypothesis": (False, True), "audio_transcript": (True, True)}


def fill(template: str, **slots: Column) -> Column:
    """The template with its slots filled in one pass, so braces inside values stay as they are."""
    import re

    parts = re.split(r"(\{\{?\w+\}?\})", template)
    cols = []
    for p in parts:
        name = p.strip("{}").lower() if p.startswith("{") else None
        cols.append(F.coalesce(slots[name], F.lit("")) if name in slots else F.lit(p))
    return F.concat(*cols)


def classification_prompt(task: str, transcript: Column, hypothesis: Column, options: Column | None = None) -> Column:
    return fill(CLASSIFY[task], transcript=transcript, hypothesis=hypothesis, options=options if options is not None else F.lit(""))


def audio_prompt(task: str, hypothesis: Column, options: Column | None = None) -> Column:
    """The question put to a model that hears the clip."""
    return fill(AUDIO[task], hypothesis=hypothesis, options=options if options is not None else F.lit(""))


def chat(system: Column, user: Column) -> Column:
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("system", system), message("user", user))


def flatten_chat(messages: Column) -> Column:
    """ROLE: content, parted by blank lines, and the assistant's turn to come."""
    return F.concat(F.array_join(F.transform(messages, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"])), "\n\n"), F.lit("\n\nASSISTANT:"))


def flatten_by_role(messages: Column) -> Column:
    """For models without a chat template: all system messages, then all of the user's, and the assistant's turn to come."""
    said = lambda role, gap: F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"]), gap)
    return F.concat(F.lit("System: "), said("system", "\n"), F.lit("\n\nUser: "), said("user", "\n\n"), F.lit("\n\nAssistant:"))


def conversations_to_text(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each conversation's turns in order as one text."""
    grouped = turns.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(turn, "role", F.col("text").alias("content")))).alias("messages"))
    return grouped.select(conv, F.size("messages").alias("n_turns"), flatten_chat(F.col("messages")).alias("prompt"))


def label_texts(df: DataFrame, task: str, hypothesis: str = "hypothesis") -> DataFrame:
    """One sentence per (row, label) for scoring."""
    rows = df.withColumn("label", F.explode(F.array(*[F.lit(x) for x in L.LABELS[L.task_family(task)]])))
    return rows.withColumn("label_text", fill(LABEL_SENTENCE, label=F.lower("label"), hypothesis=F.col(hypothesis)))


def pick_exemplars(candidates: DataFrame, k: int, seed: int) -> list[dict]:
    """``k`` distinct examples, in turn of each label; when a label runs dry, the next one with any left stands in.

    Candidates (file_name, hypothesis, answer, transcript) are put in a seeded order by hash; only the first k of each
    label reach the driver.  Fewer than k in all is an error.
    """
    distinct = candidates.filter(F.col("answer").isin(CYCLE)).groupBy("file_name", "hypothesis", "answer").agg(F.min("transcript").alias("transcript"))
    order = Window.partitionBy("answer").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "file_name", "hypothesis").cast("binary")), "file_name", "hypothesis")
    rows = distinct.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).collect()
    pools = {x: sorted((r for r in rows if r["answer"] == x), key=lambda r: r["_rank"]) for x in CYCLE}
    if len(rows) < k:
        raise ValueError(f"only {len(rows)} distinct exemplars, {k} were asked for")
    chosen = []
    for turn in range(k):
        label = next(x for x in [CYCLE[turn % 3], *CYCLE] if pools[x])
        chosen.append(pools[label].pop(0).asDict())
    return chosen


def icl_prefix(exemplars: list[dict], shots: int, transcript: bool, hypothesis: bool) -> str:
    """Header, solved examples and trailer; a few hundred characters, built once per (variant, shots)."""
    named = ["AudioFile", *(["Transcript"] if transcript else []), *(["Hypothesis"] if hypothesis else [])]
    fields = f"{', '.join(named)}, and gold Answer label" if len(named) > 1 else "AudioFile and gold Answer label"
    blocks = [ICL_HEADER.format(fields=fields)]
    for k, e in enumerate(exemplars[:shots], 1):
        lines = [f"Example {k}:", f"AudioFile: {(e['file_name'] or '').rsplit('/', 1)[-1]}"]
        lines += [f"Transcript: {(e['transcript'] or '').strip()}"] if transcript else []
        lines += [f"Hypothesis: {e['hypothesis']}"] if hypothesis else []
        blocks.append("\n".join([*lines, f"Answer: {e['answer']}", ""]))
    return "\n".join([*blocks, ICL_TRAILER])


def icl_fan_out(df: DataFrame, exemplars: list[dict], shots: list[int], variants: dict[str, tuple[bool, bool]] = VARIANTS) -> DataFrame:
    """Rows (file_name, hypothesis, transcript) times (variant, shots): ``prompt`` is the prefix and the target's block.

    The prefixes are at most a few dozen rows, broadcast; nothing is shuffled.
    """
    spark = df.sparkSession
    rows = [(v, s, icl_prefix(exemplars, s, *flags), flags[0]) for v, flags in variants.items() for s in shots]
    prefixes = F.broadcast(spark.createDataFrame(rows, "variant string, shot int, _prefix string, _with boolean"))
    target = F.concat(F.lit("Target AudioFile: "), L.base_name(F.col("file_name")), F.when(F.col("_with"), F.concat(F.lit("\nTarget Transcript: "), F.coalesce("transcript", F.lit("")))).otherwise(""), F.lit("\nTarget Hypothesis: "), F.col("hypothesis"), F.lit("\nAnswer:"))
    return df.crossJoin(prefixes).withColumn("prompt", F.concat("_prefix", F.lit("\n"), target)).drop("_prefix", "_with")


def overlay_output(output: Column, prefix: Column, task: str = "nli", suffix: Column | None = None) -> Column:
    """A record's hypothesis map with the prefix before each hypothesis, and ``suffix`` after it; an absent key becomes an empty list."""
    text = lambda v: F.coalesce(F.try_variant_get(v, "$.hypothesis", "string"), F.try_variant_get(v, "$", "string"))
    whole = lambda v: F.concat(prefix, text(v), *([suffix] if suffix is not None else []))
    return F.struct(*[F.transform(as_list(F.try_variant_get(output, f"$.{k}", "variant")), whole).alias(k) for k, _ in TASK_KEYS[task]])


def overlay_record(record: Column, prefix: Column, variant: str, shots: int, exemplars: int, task: str = "nli", transcript: bool | None = None, clip: int | None = None) -> Column:
    """A record (VARIANT with file_name, transcript, output) as text fields with each hypothesis as the target of the prompt.

    ``output`` as ``overlay_output`` gives it, null where the record's own isn't an object; ``icl_overlay`` says how it was
    made, and is null then too, so such records pass unchanged.
    """
    with_transcript, with_hypothesis = VARIANTS[variant]
    asked = with_transcript if transcript is None else transcript
    get = lambda k: L.strip(F.coalesce(F.try_variant_get(record, f"$.{k}", "string"), F.lit("")))
    output = F.try_variant_get(record, "$.output", "variant")
    target = F.concat(prefix, F.lit("Target AudioFile: "), L.base_name(get("file_name")), *([F.lit("\nTarget Transcript: "), L.clip_text(get("transcript"), clip)] if asked else []), F.lit("\nTarget Hypothesis: "))
    lists = overlay_output(output, target, task, F.lit("\nAnswer:"))
    settings = {"enabled": True, "variant": variant, "include_transcript": with_transcript, "include_exemplar_hypothesis": with_hypothesis, "include_target_transcript": asked, "max_transcript_chars": clip, "num_shots": shots, "exemplar_count": exemplars}
    how = F.struct(*[(F.lit(v).cast("int") if k == "max_transcript_chars" else F.lit(v)).alias(k) for k, v in settings.items()])
    object_there = F.coalesce(F.schema_of_variant(output).startswith("OBJECT"), F.lit(False))
    return F.struct(F.when(object_there, lists).alias("output"), F.when(object_there, how).alias("icl_overlay"))


def chunk_manifest(df: DataFrame, duration: str, size: float, overlap: float = 0.0, most: int | None = None) -> DataFrame:
    """Start of each window of ``size`` seconds: back to back, or overlapping and at most ``most``."""
    step = size - overlap
    n = F.when(F.col(duration) <= size, 1).otherwise(1 + F.ceil((F.col(duration) - size) / step)) if overlap else F.greatest(F.lit(1), F.ceil(F.col(duration) / size))
    n = F.least(n, F.lit(most)) if most else n
    return df.select("*", F.posexplode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("chunk", "_k")).withColumn("start", F.col("chunk") * F.lit(step)).drop("_k")
