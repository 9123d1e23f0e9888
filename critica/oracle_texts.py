"""Prompt texts as the oracles expect them, written out apart from the library: a text changed in
``functions/prompts.py`` alone shows as a difference in T3-T9."""

# The texts of the critic, refiner, judge, corruption and fine-tuning prompts.
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

REFINE_STRICT_HEADER = ("*** STRICT MODE ACTIVE — hallucinations persisted. "
                        "Accuracy over completeness. Remove all unverifiable claims. ***\n\n")
REFINE_INTRO = ("You are rewriting an answer to fix all identified issues.\n"
                "Priorities: (1) remove hallucinations, (2) correct facts, "
                "(3) fix logic, (4) add missing concepts.\n"
                "Do NOT mention the feedback in your answer. "
                "Return ONLY the improved answer.\n\n")
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
