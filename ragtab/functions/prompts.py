"""Prompt assembly (G3, G4, G5) as column expressions.

The template texts are parameters: the wording below is this library's own
default; only the structure (which parts go where) follows the reference.
``{company}`` is filled in from a parameter once, on the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Route labels (outcomes of the routing cascade).
ROUTE_RETRIEVAL = "retrieval"
ROUTE_COMPANY = "company_specific"
ROUTE_CYBER = "generic_cyber"
ROUTE_GENERAL = "generic_external"
ROUTES = [ROUTE_COMPANY, ROUTE_CYBER, ROUTE_GENERAL, ROUTE_RETRIEVAL]

# Judgement output format shown to the judge model, and its user prompt.
JUDGE_FORMAT = {"consistent": '(either "True" or "False")',
                "justification": "(description why the samples are consistent)"}
JUDGE_USER_PROMPT = "Compare the information"

QA_SYSTEM = ("Reply to the question as a helpful support agent for security products, in a warm tone. Where you lack "
             "the facts, tell the reader that a colleague will take over shortly.")

_BASE = "Speak for {company}, a security vendor, in the first person plural and a courteous tone. "
ROUTE_SYSTEM = {
    ROUTE_RETRIEVAL: _BASE + "Take every statement from the passages below the question; leave out what they do not say.",
    ROUTE_COMPANY: _BASE + "This is about {company}, yet no passage covers it: propose a call back by staff.",
    ROUTE_CYBER: _BASE + "Share general security know-how, mark it as a rough guide, name further reading and "
                         "promise nothing about {company} products.",
    ROUTE_GENERAL: _BASE + "The topic lies outside your field: decline kindly and invite a different question.",
}
ROUTE_USER = {
    ROUTE_COMPANY: "Write the reply described above.",
    ROUTE_GENERAL: "Decline this request in two sentences: ",
}


# Classification prompts of the model-based route tests: the model answers "True" or
# "False"; any answer containing "true" counts as yes.
COMPANY_CLASSIFIER = 'Label texts by whether they concern {company}. Output one word: "True" or "False".'
CYBER_CLASSIFIER = 'Label texts by whether their topic is computer or network security. Output one word: "True" or "False".'
COMPANY_ASK = "{company}? Text: "
CYBER_ASK = "Security topic? Text: "


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def qa_prompt(question, context=None) -> Column:
    """The question, then a space and the retrieved context when retrieval is on."""
    if context is None:
        return _c(question)
    return F.concat(_c(question), F.lit(" "), F.coalesce(_c(context), F.lit("")))


def route_system(rtype, company: str = "ACME") -> Column:
    e = None
    for r, tpl in ROUTE_SYSTEM.items():
        txt = F.lit(tpl.format(company=company))
        e = F.when(_c(rtype) == r, txt) if e is None else e.when(_c(rtype) == r, txt)
    return e


def route_user(rtype, question, context) -> Column:
    """G4 user prompt per route: question + newline + context for retrieval; a
    fixed text for the hand-off; the question for cyber; a refusal request that
    quotes the question for general."""
    r = _c(rtype)
    return (F.when(r == ROUTE_RETRIEVAL, F.concat(_c(question), F.lit("\n"), F.coalesce(_c(context), F.lit(""))))
            .when(r == ROUTE_COMPANY, F.lit(ROUTE_USER[ROUTE_COMPANY]))
            .when(r == ROUTE_CYBER, _c(question))
            .when(r == ROUTE_GENERAL, F.concat(F.lit(ROUTE_USER[ROUTE_GENERAL]), _c(question))))


def _as_text(x, nan_text: bool) -> Column:
    """Text of a value: NULL becomes '' (or 'nan', as ``str()`` of a missing
    value renders it, when ``nan_text``)."""
    return F.coalesce(_c(x).cast("string"), F.lit("nan" if nan_text else ""))


# The judge system text around information A (the answer) and B (the truth).
JUDGE_HEAD = "Two texts follow. Decide whether A agrees with B, which is taken as correct.\n\nA: "
JUDGE_MID = "\n\nB: "
JUDGE_TAIL = ("\n\nA agrees if it says much the same and contradicts nothing. Reply with a JSON object of these two keys and "
              "nothing else:\n" + json.dumps(JUDGE_FORMAT))


def judge_system(answer, truth, nan_text: bool = False) -> Column:
    """Role, task with information A (the answer) and B (the truth), and the
    output format as JSON text."""
    return F.concat(F.lit(JUDGE_HEAD), _as_text(answer, nan_text), F.lit(JUDGE_MID), _as_text(truth, nan_text),
                    F.lit(JUDGE_TAIL))


def sql_str(s: str) -> str:
    """A Python string as a DuckDB string literal (newlines kept via chr(10))."""
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)
