"""Prompt and template columns (T2-T9) built with ``concat`` / ``array_join`` / ``when``.

Prompts are data: a batch of a million critiques is one projection producing a million prompt
strings, handed to the model boundary (plans.inference) as a column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from critica.functions.common import WS_CLASS, col, ustrip

# ------------------------------------------------------------------------------------------
# Prompt texts of the reproduced generator / critic / refiner / judge /
# dataset generator / fine-tuning formatter. They must stay byte-identical for a model to see
# the same prompts.
# ------------------------------------------------------------------------------------------
GENERATOR_SYSTEM = (
    "You are a knowledgeable assistant. Answer the user's question "
    "clearly, accurately, and concisely. Prefer structured responses "
    "when the topic benefits from it."
)

CRITIC_SYSTEM = (
    "You are a strict academic peer reviewer conducting a rigorous evaluation. "
    "Your only goal is accuracy — NOT encouragement, NOT politeness. "
    "Assume errors exist until you can prove otherwise. "
    "Return ONLY valid JSON. No markdown, no prose, no explanation outside the JSON."
)

CRITIC_RULES = """EVALUATION RULES — follow exactly:
1. CORRECTNESS OVER EVERYTHING. A wrong confident answer is worse than silence.
2. If a claim cannot be verified from the question context alone, mark it as a hallucination.
   Do NOT give benefit of the doubt.
3. Assume the answer author is trying to sound knowledgeable but may be wrong.
   Scrutinise every factual claim individually.
4. Verbosity is NOT quality. Extra words that add no value are a flaw, not a feature.
5. A score of 7 or higher means the answer is GENUINELY correct and complete.
   Do NOT score above 6 if any factual error or hallucination exists.
6. If you are unsure whether a claim is correct — mark it as a potential hallucination.
7. Be critical, not helpful. Your job is to find problems, not to validate the answer."""

CRITIC_SCORING_GUIDE = """SCORING GUIDE:
 0–2  : Fundamentally wrong, dangerous misinformation, or largely fabricated.
 3–4  : Major factual errors or significant hallucinations present.
 5–6  : Partially correct; notable gaps or unverified claims remain.
 7–8  : Mostly correct; only minor issues that do not mislead.
 9–10 : Exceptional — fully accurate, complete, well-structured, no detectable errors."""

CRITIC_SCHEMA = """Respond with ONLY this JSON object — no other text:
{
  "factual_errors":      ["<specific factual claim that is wrong>"],
  "hallucinations":      ["<unverifiable or fabricated claim>"],
  "missing_concepts":    ["<important concept required but absent>"],
  "logical_flaws":       ["<specific reasoning error>"],
  "improvement_actions": ["<concrete action the writer must take>"],
  "score":               <float 0-10>,
  "confidence":          <float 0-1, your certainty in this evaluation>,
  "verdict":             "<poor | acceptable | good | excellent>"
}
Empty lists are valid and expected when no issues of that type exist."""

REFINER_SYSTEM = (
    "You are an expert editor and domain specialist. "
    "You will receive an answer and specific feedback. "
    "Rewrite the answer to fully address every issue and suggestion listed. "
    "Do NOT acknowledge the feedback in your reply — just return the improved answer."
)

REFINER_SYSTEM_STRICT = (
    "You are a rigorous fact-checker and editor operating in STRICT MODE. "
    "Hallucinations were detected and survived the previous refinement pass. "
    "Your absolute priority is factual accuracy — above completeness, above fluency. "
    "RULES: "
    "(1) Remove every claim flagged as a hallucination with no exceptions. "
    "(2) Do NOT introduce any new claim you cannot verify from the question context. "
    "(3) If a fact is uncertain, say so explicitly rather than asserting it. "
    "(4) A shorter, accurate answer is always better than a longer, fabricated one. "
    "Return ONLY the corrected answer — no commentary, no preamble."
)

REFINE_STRICT_HEADER = ("*** STRICT MODE ACTIVE — hallucinations persisted. "
                        "Accuracy over completeness. Remove all unverifiable claims. ***\n\n")
REFINE_INTRO = ("You are rewriting an answer to fix all identified issues.\n"
                "Priorities: (1) remove hallucinations, (2) correct facts, "
                "(3) fix logic, (4) add missing concepts.\n"
                "Do NOT mention the feedback in your answer. "
                "Return ONLY the improved answer.\n\n")
# (section title, feedback field, item marker) in prompt order
REFINE_SECTIONS = [
    ("[CRITICAL] HALLUCINATIONS — remove or replace with verified facts", "hallucinations", "[!]"),
    ("[CRITICAL] FACTUAL ERRORS — correct each one explicitly", "factual_errors", "[x]"),
    ("LOGICAL FLAWS — fix the reasoning", "logical_flaws", "[~]"),
    ("MISSING CONCEPTS — add where appropriate", "missing_concepts", "[ ]"),
    ("IMPROVEMENT ACTIONS — apply in order", "improvement_actions", ">>"),
]
EVIDENCE_HEADER = ("\n\n=== WEB EVIDENCE (retrieved via browser) ===\n"
                   "You are given external web evidence below. "
                   "Use it to verify claims, remove hallucinations, and improve "
                   "factual correctness. Prefer information from these sources "
                   "over your training data when they conflict.\n\n")
EVIDENCE_SEPARATOR = "\n\n---\n\n"
EVIDENCE_FOOTER = "\n=== END WEB EVIDENCE ==="

JUDGE_SYSTEM = (
    "You are a factual accuracy evaluator. "
    "Your only job is to assess whether the stated facts in an answer are correct. "
    "Ignore writing style, length, structure, and completeness. "
    "Focus exclusively on: Are the facts correct? Are there hallucinations? "
    "Return ONLY a JSON object with two fields. No prose."
)
JUDGE_HEAD = "Evaluate the factual accuracy of the following answer.\n\nQUESTION: "
JUDGE_MID = "\n\nANSWER: "
JUDGE_TAIL = """

Judge ONLY factual correctness. Ignore completeness, style, and length.

Respond with ONLY this JSON:
{
  "factual_accuracy_score": <float 0-10, where 10=fully accurate, 0=fabricated/wrong>,
  "hallucinations_detected": <true | false>,
  "reasoning": "<one sentence explaining the score>"
}"""

CORRUPTION_TEMPLATES = [
    "Rewrite the following answer but subtly introduce a factual error about dates or inventors:\n\n",
    "Rewrite the following answer but remove the most crucial part of the explanation, leaving it incomplete:\n\n",
    "Rewrite the following answer and add a hallucinated reference to a non-existent scientific paper (e.g. 'Smith et al. 2019'):\n\n",
    "Rewrite the following answer but make the conclusion logically contradict the premises you stated:\n\n",
]

SFT_INSTRUCTION = ("Evaluate the quality of the answer and provide structured critique. "
                   "Return ONLY valid JSON matching the schema shown.")
SFT_HEAD = "### Instruction:\n"
SFT_INPUT = "\n\n### Input:\nQuery: "
SFT_ANSWER = "\nAnswer: "
RESPONSE_MARKER = "### Response:\n"
SFT_RESPONSE = "\n\n" + RESPONSE_MARKER
SFT_KEYS = ["hallucinations", "factual_errors", "missing_concepts", "logical_flaws", "score", "verdict"]


# ---------------------------------------------------------------- T2 / T3 / T5 / T7
def generation_prompt(query) -> Column:
    """T2."""
    return F.concat(F.lit("Question: "), col(query), F.lit("\n\nAnswer:"))


def critic_prompt(query, answer) -> Column:
    """Rules, guide, query, answer and the response schema."""
    return F.concat(F.lit(CRITIC_RULES + "\n\n" + CRITIC_SCORING_GUIDE + "\n\nQUERY TO ANSWER:\n"),
                    col(query), F.lit("\n\nANSWER UNDER REVIEW:\n"), col(answer),
                    F.lit("\n\n" + CRITIC_SCHEMA))


def judge_prompt(query, answer) -> Column:
    """T5."""
    return F.concat(F.lit(JUDGE_HEAD), col(query), F.lit(JUDGE_MID), col(answer), F.lit(JUDGE_TAIL))


def pair_text(query, answer) -> Column:
    """Learned-critic input text."""
    return F.concat(F.lit("Query: "), col(query), F.lit(" [SEP] Answer: "), col(answer))


# ---------------------------------------------------------------- T4
def _section(title: str, items: Column, marker: str) -> Column:
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit(f"  {marker} "), x)), "\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0,
                  F.concat(F.lit(f"{title}:\n"), lines)).otherwise(F.lit(f"{title}: (none)"))


def refine_prompt(query, answer, feedback, strict_mode, evidence=None) -> Column:
    """T4: strict header, seven sections ('(none)' for empty lists), evidence block only when
    pages were retrieved. ``evidence``: ARRAY<STRUCT<url, content>> or None."""
    fb = col(feedback)
    score_txt = fb.getField("score").cast("string")
    parts = [
        F.concat(F.lit("ORIGINAL QUESTION:\n"), col(query)),
        F.concat(F.lit("CURRENT ANSWER  [critic score: "), score_txt, F.lit("/10  verdict: "),
                 fb.getField("verdict"), F.lit("]:\n"), col(answer)),
    ] + [_section(t, fb.getField(f), m) for t, f, m in REFINE_SECTIONS]
    sections = F.concat_ws("\n\n", *parts)
    header = F.when(col(strict_mode), F.lit(REFINE_STRICT_HEADER)).otherwise(F.lit(""))
    if evidence is None:
        block = F.lit("")
    else:
        ev = col(evidence)
        pages = F.transform(ev, lambda p, i: F.concat(
            F.lit("[Source "), (i + 1).cast("string"), F.lit("] "), p.getField("url"), F.lit("\n"),
            p.getField("content")))
        block = F.when(F.coalesce(F.size(ev), F.lit(0)) > 0, F.concat(
            F.lit(EVIDENCE_HEADER), F.array_join(pages, EVIDENCE_SEPARATOR),
            F.lit(EVIDENCE_FOOTER))).otherwise(F.lit(""))
    return F.concat(header, F.lit(REFINE_INTRO), sections, block)


def refine_system_prompt(strict_mode) -> Column:
    return F.when(col(strict_mode), F.lit(REFINER_SYSTEM_STRICT)).otherwise(F.lit(REFINER_SYSTEM))


# ---------------------------------------------------------------- T6 (portable hash, Q11)
def portable_hash(*parts) -> Column:
    """First 8 hex digits of md5(parts joined by '|') as a non-negative integer.

    Deterministic and reproducible outside Spark (DuckDB: ('0x' || substr(md5(s), 1, 8))::BIGINT),
    unlike ``hash``/``xxhash64``."""
    s = F.concat_ws("|", *[col(p).cast("string") if not isinstance(p, Column) else p.cast("string")
                           for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def corruption_index(key, k, seed: int = 42) -> Column:
    return F.pmod(portable_hash(col(key), col(k), F.lit(seed)), F.lit(len(CORRUPTION_TEMPLATES)))


def corruption_prompt(answer, key, k, seed: int = 42) -> Column:
    """One of four corruption instructions, picked by a seeded portable hash of (key, k)."""
    templates = F.array(*[F.lit(t) for t in CORRUPTION_TEMPLATES])
    idx = corruption_index(key, k, seed)
    return F.concat(F.element_at(templates, (idx + 1).cast("int")), col(answer))


# ---------------------------------------------------------------- T8 / T9
def sft_prompt(query, answer) -> Column:
    return F.concat(F.lit(SFT_HEAD + SFT_INSTRUCTION + SFT_INPUT), col(query), F.lit(SFT_ANSWER),
                    col(answer), F.lit(SFT_RESPONSE))


def sft_response(feedback) -> Column:
    """Six feedback keys in fixed order; missing score -> 5.0 (rounded to 2), missing verdict ->
    'acceptable'. Compact JSON (the reproduced formatter indents; parsed fields are equal)."""
    from critica.functions.common import py_round
    fb = col(feedback)
    empty = F.array().cast("array<string>")
    return F.to_json(F.struct(
        F.coalesce(fb.getField("hallucinations"), empty).alias("hallucinations"),
        F.coalesce(fb.getField("factual_errors"), empty).alias("factual_errors"),
        F.coalesce(fb.getField("missing_concepts"), empty).alias("missing_concepts"),
        F.coalesce(fb.getField("logical_flaws"), empty).alias("logical_flaws"),
        py_round(F.coalesce(fb.getField("score").cast("double"), F.lit(5.0)), 2).alias("score"),
        F.coalesce(fb.getField("verdict"), F.lit("acceptable")).alias("verdict")))


def sft_text(query, answer, feedback) -> Column:
    """Instruction prompt followed by the feedback JSON."""
    return F.concat(sft_prompt(query, answer), sft_response(feedback))


# Default tokenizer: whitespace-delimited pieces hashed into a vocabulary (pluggable - a real
# tokenizer's ids can be supplied as an ARRAY<INT> column instead).
VOCAB = 32000
PAD_ID, BOS_ID, EOS_ID = 0, 1, 2


def whitespace_pieces(text) -> Column:
    """Maximal runs of non-whitespace (Python ``str.split()`` pieces): the stripped text split on
    whitespace runs - the same pieces as extracting non-whitespace runs, several times cheaper."""
    s = ustrip(col(text))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, WS_CLASS + "+", -1))


def hash_token_ids(text, max_length: int | None = None) -> Column:
    pieces = whitespace_pieces(text)
    if max_length is not None:
        pieces = F.slice(pieces, 1, max_length)  # hash only what is kept
    return F.transform(pieces, lambda t: (F.pmod(portable_hash(t), F.lit(VOCAB)) + F.lit(3)).cast("int"))


def mask_labels(text, max_length: int = 512, ids: Column | None = None,
                prompt_ids: Column | None = None) -> Column:
    """struct(input_ids, attention_mask, labels). Token ids truncated to ``max_length``;
    labels are -100 for the prompt tokens (everything up to the first '### Response:\\n');
    EOS is appended to all three when the sequence is shorter than ``max_length``."""
    t = col(text)
    full = F.slice(ids if ids is not None else hash_token_ids(t, max_length), 1, max_length)
    prompt_text = F.concat(F.substring_index(t, RESPONSE_MARKER, 1), F.lit(RESPONSE_MARKER))
    n_prompt = F.least(F.size(prompt_ids if prompt_ids is not None else whitespace_pieces(prompt_text)), F.lit(max_length))

    def masks(x: Column) -> Column:  # x.ids and x.n are lambda variables: computed once, used many times
        i, n = x.getField("ids"), x.getField("n")
        size = F.size(i)
        add_eos = size < F.lit(max_length)
        eos = F.array(F.lit(EOS_ID))
        labels = F.transform(i, lambda v, at: F.when(at < n, F.lit(-100)).otherwise(v))
        return F.struct(
            F.when(add_eos, F.concat(i, eos)).otherwise(i).alias("input_ids"),
            F.array_repeat(F.lit(1), size + add_eos.cast("int")).alias("attention_mask"),
            F.when(add_eos, F.concat(labels, eos)).otherwise(labels)
            .alias("labels"))

    return F.transform(F.array(F.struct(full.alias("ids"), n_prompt.alias("n"))), masks)[0]
