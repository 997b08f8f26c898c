"""The prompt-injection line scanner as one projection: fences blanked in the whole text, then lines, then matched rules.  Nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.functions import text as X

# Rule names, patterns, literal tokens and messages.
DEFAULT_RULES = ("role-spoof", "instruction-override")
OPTIONAL_RULES = ("delimiter-spoof", "tool-exfil")
ROLE_LINE = r"(?U)^\s*(System|Assistant|Human|User|AI)\s*:"
CHAT_TOKENS = ("<|im_start|>", "<|im_end|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OVERRIDE = r"(?iU)\b(ignore|disregard|forget)\b[^\n]{0,200}?\b(previous|above|prior|earlier|all)\b[^\n]{0,200}?\b(instruction|instructions|prompt|prompts|context|rule|rules)\b"
NEW_INSTRUCTION = r"(?iU)\bnew\s+instructions?\s*:"
DASHES = r"(?U)^\s*---\s*$"
HEADING = r"(?iU)^#{1,6}\s*(system|instructions?|prompt)\b"
EXFIL = r"(?iU)\b(print|reveal|show|repeat|output|display)\b[^\n]{0,200}?\b(system prompt|your instructions|the prompt above|previous prompt)\b"
ROLE_SAID, TOKEN_SAID, OVERRIDE_SAID = "possible role impersonation", "chat-template token '{}'", "possible instruction override"
DASHES_SAID, HEADING_SAID, EXFIL_SAID = "delimiter spoofing ('---')", "system-like heading", "possible prompt exfiltration"
SNIPPET = 120

#: The word before ``-allow:`` in the comments that silence rules.
PREFIX = "leafgraph"
FENCE = r"(?Umd)^[\s\x1c-\x1f&&[^\n]]*```[^\n]*"


def _message(rule: str, line: Column, number: Column) -> Column:
    """The finding's message, null where the rule doesn't match."""
    if rule == "role-spoof":
        out = F.when(line.rlike(ROLE_LINE), ROLE_SAID)
        for token in CHAT_TOKENS:
            out = out.when(F.contains(line, F.lit(token)), TOKEN_SAID.format(token))
        return out
    if rule == "instruction-override":
        return F.when(line.rlike(OVERRIDE) | line.rlike(NEW_INSTRUCTION), OVERRIDE_SAID)
    if rule == "delimiter-spoof":
        return F.when((number > 1) & line.rlike(DASHES), DASHES_SAID).when(line.rlike(HEADING), HEADING_SAID)
    if rule == "tool-exfil":
        return F.when(line.rlike(EXFIL), EXFIL_SAID)
    return F.lit(None).cast("string")


def unfenced(text: Column) -> Column:
    """The text with fence lines and all between them blanked, line breaks kept; an unclosed fence runs to the end."""
    parts = F.split(text, FENCE, -1)
    return F.array_join(F.transform(parts, lambda part, i: F.when(i % 2 == 1, F.regexp_replace(part, r"[^\n]+", "")).otherwise(part)), "")


def allowed(text: Column, prefix: str = PREFIX) -> Column:
    """The rules that comments of the whole text, fenced or not, allow."""
    lists = F.regexp_extract_all(text, F.lit(rf"<!--\s*\Q{prefix}\E-allow:\s*([^>]*?)\s*-->"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, ","), X.strip))))


def scan(docs: DataFrame, source: str = "source", text: str = "text", rules: tuple[str, ...] = DEFAULT_RULES, prefix: str = PREFIX) -> DataFrame:
    """rule, severity, source, line, snippet, message of every finding; a list of rules replaces the default ones, unknown ones find nothing.

    Every document is scanned by itself, also where sources repeat.  An allowed rule is silent in its document, and ``all`` silences every rule.
    """
    body = F.col(text)
    rows = docs.select(F.col(source).alias("source"), allowed(body, prefix).alias("allowed"), unfenced(body).alias("body"))
    rows = rows.where(~F.array_contains("allowed", "all")).select("source", "allowed", F.posexplode(F.split("body", "\n", -1)).alias("pos", "content"))
    rows = rows.withColumn("line", F.col("pos") + 1)
    found = F.array(*(F.struct(F.lit(r).alias("rule"), _message(r, F.col("content"), F.col("line")).alias("message")) for r in dict.fromkeys(rules or ("",))))
    out = rows.select("source", "line", "allowed", "content", F.explode(F.filter(found, lambda x: x["message"].isNotNull())).alias("x"))
    return out.where(~F.array_contains("allowed", F.col("x.rule"))).select("x.rule", F.lit("warning").alias("severity"), "source", "line", F.substring(X.strip(F.col("content")), 1, SNIPPET).alias("snippet"), "x.message")


def rules_with(extra: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The default rules and those asked for beside them, each once."""
    return tuple(dict.fromkeys((*DEFAULT_RULES, *extra)))
