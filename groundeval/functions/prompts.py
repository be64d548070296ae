"""Prompt construction and prompt-label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundeval.functions.text import capitalize, strip, strip_ends

# Fixed values of the prompt templates.
PLACEHOLDER = "{{ QUESTION }}"
TWO_STEP_ANSWER_PREFIX = "Output the answer only. "
TWO_STEP_ANSWER_SUFFIX_NQ = "?\nAnswer string only:"
TWO_STEP_ANSWER_SUFFIX = "\nAnswer string only:"
TWO_STEP_EXPLAIN_HEAD = "Question: "
TWO_STEP_EXPLAIN_MID = "\nAnswer: ANSWER\n\n"
TWO_STEP_EXPLAIN_ASK = "\n\nGive a detailed explanation for why this is true."
TWO_STEP_EXPLAIN_TAIL = "\nExplanation:"
ANSWER_SLOT = "ANSWER"
HOSTED_MODELS = ["gpt3", "gpt4", "chatgpt"]
# Boilerplate preamble removed from prompt keys (newlines already escaped as \n).
BOILERPLATE = (
    "You are a highly intelligent & complex question-answer generative model. You take a question as an input "
    "and answer it by imitating the way a human gives short answers with a corresponding explanation. You answer "
    "should be short - only a few words.\\n\\nYour output format should be the answer, then a semicolon, then the "
    "explanation.\\n"
)
ATTRIBUTION_SENTENCE = "Respond to this question using only information that can be attributed to Wikipedia"
GROUNDED_MARKER = "Respond to this question using"
NULL_PROMPT_TEXT = "$\\emptyset$ (no additional prompt)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def insert_prompt(before, after, prompt, location, location_specific) -> tuple[Column, Column]:
    """Grid insertion rule: returns the new (prompt_before, prompt_after)."""
    b, a, p, loc, spec = map(_c, (before, after, prompt, location, location_specific))
    new_b = F.when(loc == "before", F.when(spec == "before", F.concat(p, b)).otherwise(F.concat(b, p))).otherwise(b)
    new_a = F.when(loc == "after", F.when(spec == "after", F.concat(a, p)).otherwise(F.concat(p, a))).otherwise(a)
    return new_b, new_a


def is_single_step(dataset, model) -> Column:
    return F.lower(_c(dataset)).contains("eli5") | F.lower(_c(model)).isin(*HOSTED_MODELS)


def asks_nq(dataset) -> Column:
    return F.lower(_c(dataset)).contains("nq")


def render_single(before, question, after) -> Column:
    """``strip(before + question.capitalize() + after)``; null parts count as ''."""
    return strip(F.concat(F.coalesce(_c(before), F.lit("")), capitalize(question), F.coalesce(_c(after), F.lit(""))))


def render_two_step(question, after, dataset, *, nq=None, capital=None) -> tuple[Column, Column]:
    """(answer prompt, explanation prompt) of the two-step flow; ``prompt_before`` is unused.
    ``nq`` and ``capital``: ``asks_nq`` of the dataset and the question capitalised, if known."""
    q = _c(question)
    nq, capital = asks_nq(dataset) if nq is None else _c(nq), capitalize(q) if capital is None else _c(capital)
    suffix = F.when(nq, F.lit(TWO_STEP_ANSWER_SUFFIX_NQ)).otherwise(F.lit(TWO_STEP_ANSWER_SUFFIX))
    p1 = F.concat(F.lit(TWO_STEP_ANSWER_PREFIX), capital, suffix)
    p2 = F.concat(
        F.lit(TWO_STEP_EXPLAIN_HEAD), q, F.lit(TWO_STEP_EXPLAIN_MID), F.lit(TWO_STEP_EXPLAIN_ASK),
        F.coalesce(_c(after), F.lit("")), F.lit(TWO_STEP_EXPLAIN_TAIL),
    )
    return p1, p2


def ends_with_quote(before) -> Column:
    b = F.coalesce(_c(before), F.lit(""))
    return (F.length(b) > 0) & b.endswith('"')


def compose_two_step(answer_prompt, answer_out, explain_prompt, explain_out) -> Column:
    """Second pass of the two-step flow: echo of the prompt removed from each output, both
    stripped, joined as ``answer;explanation``; the explanation prompt gets the answer
    substituted for ``ANSWER`` before its echo is removed."""
    ans = strip_ends(F.replace(_c(answer_out), _c(answer_prompt), F.lit("")))
    filled = fill_answer_slot(explain_prompt, ans)
    expl = strip_ends(F.replace(_c(explain_out), filled, F.lit("")))
    return F.concat(ans, F.lit(";"), expl)


def fill_answer_slot(explain_prompt, answer) -> Column:
    return F.replace(_c(explain_prompt), F.lit(ANSWER_SLOT), _c(answer))


def prompt_key(before, after) -> Column:
    """``before + '{{ QUESTION }}' + after`` with newlines escaped as the two characters \\n."""
    esc = lambda c: F.replace(F.coalesce(_c(c), F.lit("")), F.lit("\n"), F.lit("\\n"))
    return F.concat(esc(before), F.lit(PLACEHOLDER), esc(after))


def strip_boilerplate(key, drop_escaped_newlines: bool = False) -> Column:
    s = F.replace(_c(key), F.lit(BOILERPLATE), F.lit(""))
    s = F.replace(s, F.lit("}}?"), F.lit("}}"))
    s = F.replace(s, F.lit("}} "), F.lit("}}"))
    if drop_escaped_newlines:
        s = F.replace(s, F.lit("\\n"), F.lit(""))
    return s


def attribution_label(key) -> Column:
    """The attribution sentence when present, else the string 'null'."""
    return F.when(_c(key).contains(ATTRIBUTION_SENTENCE), F.lit(ATTRIBUTION_SENTENCE)).otherwise(F.lit("null"))


def null_vs_grounded(key, grounded: str = "Grounded") -> Column:
    return F.when(_c(key) == PLACEHOLDER, F.lit("Null")).otherwise(F.lit(grounded))


def grounded_marker_label(key) -> Column:
    return F.when(_c(key).contains(GROUNDED_MARKER), F.lit("Grounded")).otherwise(F.lit("Null"))


def display_text(key) -> Column:
    """Escaped newlines → spaces, stripped, placeholder removed; empty → the null-prompt text."""
    s = F.replace(strip(F.replace(_c(key), F.lit("\\n"), F.lit(" "))), F.lit(PLACEHOLDER), F.lit(""))
    return F.when(s == "", F.lit(NULL_PROMPT_TEXT)).otherwise(strip(s))


def join_candidates(candidates) -> Column:
    """Several generations of one prompt (an array column, or a list of columns): each stripped,
    joined by a space."""
    if isinstance(candidates, list):
        return F.concat_ws(" ", *map(strip_ends, map(_c, candidates)))
    return F.array_join(F.transform(_c(candidates), strip_ends), " ")
