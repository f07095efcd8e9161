"""Chat-text expressions: content cleaner, pair hash, prompt templates
(P-7, P-9, P-25..P-28, P-34)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, col_, collapse_ws, py_strip

# Fixed values that must equal the reference rules.
USER_MARKERS = ["user:", "human:", "question:", "q:"]
ASSISTANT_MARKERS = ["assistant:", "ai:", "answer:", "response:", "a:"]
CLEAN_PREFIXES = ["user:", "assistant:", "human:", "ai:", "question:", "answer:", "response:", "q:", "a:"]
VARIABLE_GROUPS = [
    (["task", "action"], "specific programming task or action"),
    (["problem", "issue", "error"], "specific problem, issue, or error type"),
    (["concept", "topic"], "programming concept or topic"),
    (["fix", "solution"], "detailed solution or fix"),
    (["explanation", "details"], "detailed explanation or implementation details"),
]
DEFAULT_JUDGE_TOPIC = "React JS"

# Generation prompt text (fixed values).
PROMPT_VARS_HEAD = (
    "\n\nIMPORTANT: Replace template variables naturally with specific content. "
    "Do NOT explain what you're doing or mention templates.\n\nVariables to replace: "
)
PROMPT_VARS_MEANINGS = "\n\nVariable meanings:"
PROMPT_VARS_TAIL = "\n\nAlways replace ALL variables with concrete, specific content. Make each generation unique and varied."
PROMPT_HEAD = "Generate exactly one realistic conversation about "
PROMPT_FORMAT = '.\n\nFormat:\nUser: [question/request following pattern: "'
PROMPT_FORMAT_2 = '"]\nAssistant: [helpful response following pattern: "'
PROMPT_RULES = (
    '"]\n{vars}\n\nRules:\n- Replace ALL {{variables}} with specific, natural content\n'
    "- Make conversation realistic and helpful\n"
    "- Do NOT mention templates, variables, or generation process\n"
    "- Keep responses focused and practical\n"
    "- Vary content for diversity"
)

# Judge prompt text (fixed values).
JUDGE_HEAD = "\nEvaluate this conversation about {topic} on a scale of 1-10:\n\nUser: "
JUDGE_MID = "\nAssistant: "
JUDGE_TAIL = (
    "\n\nRate each aspect (1-10):\n"
    "1. RELEVANCE: Does the assistant directly address the user's question?\n"
    "2. ACCURACY: Is the technical information correct and reliable?\n"
    "3. COMPLETENESS: Does it provide a complete solution/answer?\n"
    "4. CLARITY: Is the response clear and easy to understand?\n"
    "5. SPECIFICITY: Are examples concrete and specific (not generic)?\n\n"
    "Format your response as:\n"
    "RELEVANCE: [score]\n"
    "ACCURACY: [score] \n"
    "COMPLETENESS: [score]\n"
    "CLARITY: [score]\n"
    "SPECIFICITY: [score]\n"
    "OVERALL: [average score]\n"
    "REASON: [brief explanation]"
)


def clean_content(c: Column | str) -> Column:
    """P-9: strip; drop each known role prefix once, in order; unwrap quotes;
    collapse blanks; delete unfilled ``{slots}``."""
    x = py_strip(F.coalesce(col_(c), F.lit("")))
    # each prefix at most once, in list order, blanks after each removed: one
    # anchored regex of optional groups (greedy, so no group is skipped)
    groups = "".join(f"(?:{p}{WS}*)?" for p in CLEAN_PREFIXES)
    x = F.regexp_replace(x, f"(?i)^{groups}", "")
    inner = F.when(F.length(x) >= 2, py_strip(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(F.lit(""))
    x = (F.when(x.startswith('"') & x.endswith('"'), inner)
         .when(x.startswith("'") & x.endswith("'"), inner)
         .otherwise(x))
    x = py_strip(collapse_ws(x))
    x = F.regexp_replace(x, r"\{[^}]*\}", "")
    return py_strip(collapse_ws(x))


def pair_hash(user: Column | str, assistant: Column | str) -> Column:
    """P-7: md5 of stripped user text followed by stripped assistant text."""
    return F.md5(F.concat(py_strip(F.coalesce(col_(user), F.lit(""))), py_strip(F.coalesce(col_(assistant), F.lit("")))))


#: Word characters as the reference's patterns have them: letters, digits and underscore of any script.
WORD_NAME = r"[\p{L}\p{N}_]+"


def remove_prompt_echo(text: Column | str, prompt: Column | str) -> Column:
    """P-34: drop an echoed prompt (then strip), only when it occurs."""
    t, p = col_(text), col_(prompt)
    return F.when((F.length(p) > 0) & t.contains(p), py_strip(F.replace(t, p, F.lit("")))).otherwise(t)


def template_variables(*templates: Column, name: str = r"[^}]+") -> Column:
    """P-25 + A-17 + SET-3: sorted distinct ``{name}`` variables of the templates;
    ``name`` is what may stand in the braces (``WORD_NAME`` in the interactive form)."""
    found = [F.regexp_extract_all(t, F.lit(r"\{(" + name + r")\}"), 1) for t in templates]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def variable_description(var: Column, descriptions: Column, topic: Column) -> Column:
    """P-26 + J-7: caller description, else a name-group default, else generic."""
    lv = F.lower(var)
    default = F.concat(F.lit("specific "), var, F.lit(" related to "), topic)
    for names, text in reversed(VARIABLE_GROUPS):
        default = F.when(lv.isin(names), F.lit(text)).otherwise(default)
    given = F.when(descriptions.isNotNull(), F.try_element_at(descriptions, var))
    return F.when(F.coalesce(F.map_contains_key(descriptions, var), F.lit(False)), given).otherwise(default)


def generation_prompt(topic: Column, input_t: Column, output_t: Column, variables: Column, descriptions: Column) -> Column:
    """P-27: the generation instruction for one template spec."""
    lines = F.transform(variables, lambda v: F.concat(F.lit("\n- {"), v, F.lit("}: "),
                                                      variable_description(v, descriptions, topic)))
    var_block = F.when(
        F.size(variables) > 0,
        F.concat(F.lit(PROMPT_VARS_HEAD), F.array_join(variables, ", "), F.lit("\nTopic: "), topic,
                 F.lit(PROMPT_VARS_MEANINGS), F.array_join(lines, ""), F.lit(PROMPT_VARS_TAIL)),
    ).otherwise(F.lit(""))
    rules_head, rules_tail = PROMPT_RULES.split("{vars}")
    body = F.concat(F.lit(PROMPT_HEAD), topic, F.lit(PROMPT_FORMAT), input_t, F.lit(PROMPT_FORMAT_2), output_t,
                    F.lit(rules_head), var_block, F.lit(rules_tail.replace("{{", "{").replace("}}", "}")))
    return py_strip(body)


def judge_prompt(user: Column, assistant: Column, topic: Column | None = None) -> Column:
    """P-28: the evaluation instruction for one (user, assistant) pair."""
    topic = topic if topic is not None else F.lit(DEFAULT_JUDGE_TOPIC)
    head_a, head_b = JUDGE_HEAD.split("{topic}")
    return F.concat(F.lit(head_a), topic, F.lit(head_b), user, F.lit(JUDGE_MID), assistant, F.lit(JUDGE_TAIL))
