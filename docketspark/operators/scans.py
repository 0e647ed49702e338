"""Scans of texts for manipulation, as a frame of signals over native expressions: no Python, no shuffle.

A signal is a pattern with a severity and a confidence that grows with the number of its matches.  A text's
findings are one array, so its score, level and action are folds over the row; exploding the array gives one
row a finding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.functions.text import ZERO_WIDTH, mixed_script_words, repetition_ratio
from docketspark.session import spread


@dataclass(frozen=True)
class Signal:
    """Confidence is min(base + step * matches, cap); more than ``many`` matches raise the severity to high."""

    technique: str
    category: str
    pattern: str
    severity: str
    base: int
    step: int = 0
    cap: int = 100
    many: int | None = None
    gate: tuple[str, ...] = ()  # the lower-case text holds one of these wherever the pattern matches


_NO_LETTER_LEFT, _NO_LETTER_RIGHT = r"(?<!\p{L})", r"(?!\p{L})"

# ---------------------------------------------------------------- fixed values
# Patterns, severities, confidences, weights and thresholds are fixed values of the scans.

ADVERSARIAL: tuple[Signal, ...] = tuple(
    Signal(technique, "adversarial", pattern, severity, 80, 5, 98, gate=tuple(gate.split()))
    for technique, severity, gate, pattern in (
        ("prompt-injection-pl", "high", "zignoruj pomi zapomnij odrzu", rf"(?iu){_NO_LETTER_LEFT}(?:zignoruj|pomi[nń]|zapomnij|odrzu[cć])\s+(?:wszystkie\s+)?(?:poprzednie|powy[zż]sze|wcze[sś]niejsze|dotychczasowe)\s+(?:instrukcje|polecenia|wytyczne|ustalenia|zasady)"),
        ("prompt-injection-pl-newrole", "high", "dzia udawaj wciel", rf"(?iu){_NO_LETTER_LEFT}(?:dzia[lł]aj\s+(?:jako|jak)|udawaj,?\s+[zż]e\s+jeste[sś]|wciel\s+si[eę]\s+w){_NO_LETTER_RIGHT}"),
        ("prompt-injection-pl-reveal", "high", "ujawnij poka wypisz wyswietl zdrad", rf"(?iu){_NO_LETTER_LEFT}(?:ujawnij|poka[zż]|wypisz|wyswietl|zdrad[zź])\s+(?:sw[oó]j\s+)?(?:prompt\s+systemowy|instrukcje\s+systemowe|polecenie\s+systemowe|konfiguracj[eę]|ustawienia\s+systemowe)"),
        ("jailbreak-pl-mode", "high", "tryb bez pomi", rf"(?iu){_NO_LETTER_LEFT}(?:tryb\s+(?:dewelopera|deweloperski|bez\s+ogranicze[nń]|nieocenzurowany|swobodny)|bez\s+(?:filtr[oó]w|cenzury|ogranicze[nń])|pomi[nń]\s+(?:zabezpieczenia|filtry|zasady\s+bezpiecze[nń]stwa)){_NO_LETTER_RIGHT}"),
        ("prompt-injection-en", "high", "ignore disregard forget", r"(?i)\b(?:ignore|disregard|forget)\s+(?:all\s+)?(?:previous|above|prior|earlier)\s+(?:instructions|prompts|commands|rules)"),
        ("prompt-injection-en-marker", "medium", "[ <| ###", r"(?i)\[(?:SYSTEM|ADMIN|INST|/INST)\]|<\|(?:system|im_start|im_end)\|>|###\s*system"),
        ("jailbreak-en-known", "high", "dan stan dude aim anything developer jailbreak", r"(?i)\b(?:DAN|STAN|DUDE|AIM)\b|do\s+anything\s+now|developer\s+mode|jailbreak"),
    )
)

EVASION: tuple[Signal, ...] = (
    Signal("token-boundary-splitting", "evasion", r"(?:\b\p{L}\s+){4,}\p{L}\b", "medium", 70),
    Signal("combining-mark-stacking", "evasion", r"[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u20d0-\u20ff]{3,}", "medium", 75),
    Signal("unicode-tag-chars", "evasion", r"[\x{e0000}-\x{e007f}]", "high", 90),
    Signal("bidi-control-chars", "obfuscation", r"[\u202a-\u202e\u2066-\u2069]", "high", 85),
    Signal("zero-width-chars", "steganography", ZERO_WIDTH, "medium", 50, 5, 95, many=8),
)

#: Severity -> weight in the score of a document, and of a connector.
WEIGHTS = {"low": 8, "medium": 20, "high": 40, "critical": 100}
CONNECTOR_WEIGHTS = {"low": 1, "medium": 4, "high": 10, "critical": 30}
SEVERITIES = ["low", "medium", "high", "critical"]
ACTIONS = {"low": "allowed", "medium": "quarantined", "high": "human_review", "critical": "blocked"}
CONNECTOR_ACTIONS = {"low": "audit", "medium": "human_review", "high": "human_review", "critical": "denied"}
CONNECTOR_ACTION_ORDER = ["allowed", "audit", "human_review", "denied"]

HIDDEN_INSTRUCTIONS: tuple[tuple[str, str, str], ...] = (
    ("ignore-previous-EN", "critical", r"(?i)ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|rules?)"),
    ("disregard-previous-EN", "critical", r"(?i)disregard\s+(all\s+)?(previous|prior|above)"),
    ("system-tag", "critical", r"(?i)</?system\b[^>]*>"),
    ("assistant-tag", "critical", r"(?i)</?assistant\b[^>]*>"),
    ("role-override-EN", "critical", r"(?i)\byou\s+are\s+now\s+(?:a|an|the)\s+"),
    ("new-system-prompt-EN", "critical", r"(?i)\bnew\s+system\s+prompt\b"),
    ("ignore-previous-PL", "critical", r"(?i)\bzignoruj\s+(wszystkie\s+)?(poprzednie|powyzsze)\s+(instrukcje|reguly|polecenia)"),
    ("role-override-PL", "critical", r"(?i)\b(jestes|bedziesz)\s+(teraz\s+)?(asystentem|botem|systemem)\b"),
    ("new-system-prompt-PL", "critical", r"(?i)\bnowy\s+(system\s+)?prompt\b"),
    ("from-now-PL", "critical", r"(?i)\bod\s+teraz\s+(jestes|odpowiadasz|dzialasz)"),
    ("must-always-EN", "high", r"(?i)\byou\s+must\s+(always|never)\b"),
    ("act-as-EN", "high", r"(?i)\bact\s+as\s+(?:a|an|the)\s+"),
    ("pretend-EN", "high", r"(?i)\bpretend\s+(?:to\s+be|that)\b"),
    ("pretend-PL", "high", r"(?i)\budawaj\s+(ze|jakbys|zwykle)\b"),
    ("must-always-PL", "high", r"(?i)\bmusisz\s+(zawsze|nigdy)\b"),
)

TOOL_POISONING: tuple[tuple[str, str, str], ...] = (
    ("additionally-requires-EN", "high", r"(?i)\badditionally\s+(requires|reads|accesses|writes)"),
    ("also-action-EN", "high", r"(?i)\balso\s+(reads|writes|sends|uploads|deletes)"),
    ("send-to-external-EN", "high", r"(?i)\b(send|upload|post)s?\s+to\s+(https?://|\w+@)"),
    ("writes-system-path-EN", "high", r"(?i)\bwrites?\s+to\s+(/etc|/var|/root|C:\\Windows|/System)"),
    ("delete-action-EN", "high", r"(?i)\b(deletes?|removes?)\s+(files?|directories|tables?)"),
    ("additionally-PL", "high", r"(?i)\bdodatkowo\s+(wymaga|czyta|wysyla|zapisuje)"),
    ("also-action-PL", "high", r"(?i)\browniez\s+(czyta|wysyla|zapisuje|usuwa)"),
    ("send-to-external-PL", "high", r"(?i)\bwysyla\s+do\s+(https?://|\w+@)"),
    ("delete-action-PL", "high", r"(?i)\b(usuwa|kasuje)\s+(pliki|katalogi|tabele)"),
)

MENTIONED_FIELD = r"(?i)\b(?:parameter|argument|input|field|pole|parametr)\s+`?([a-zA-Z_][a-zA-Z0-9_]{1,40})`?"
BASE64 = r"\b([A-Za-z0-9+/]{60,}={0,2})\b"

#: Marks in the bytes of a PDF.
PDF_SCRIPT = r"/JavaScript|/JS[ /(<]"
PDF_AUTO = r"/OpenAction|/AA"

# ---------------------------------------------------------------- operators


#: The ends of ASCII words, which Java's own \\b does not mean.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _java(pattern: str) -> str:
    return pattern.replace(r"\b", _EDGE)


def _finding(technique: str, category: str, severity: Column, confidence: Column, n: Column) -> Column:
    return F.struct(F.lit(technique).alias("technique"), F.lit(category).alias("category"), severity.alias("severity"), confidence.cast("int").alias("confidence"), n.cast("long").alias("n"))


def base64_readable(c: Column) -> Column:
    """Whether the first long run of base64 letters decodes to more than 10 characters with a word of four letters."""
    run = F.regexp_extract(c, _java(BASE64), 1)
    whole = F.left(run, (F.length(run) / 4).cast("int") * 4)
    text = F.make_valid_utf8(F.try_to_binary(whole, F.lit("base64")).cast("string"))
    return F.coalesce((F.length(text) > 10) & text.rlike(r"[a-zA-Ząćęłńóśźż]{4,}"), F.lit(False))


def _counts(c: Column) -> Column:
    """How often each signal occurs, as one array: the only part that reads the text."""
    low = F.lower(c)

    def gated(s: Signal) -> Column:
        n = F.regexp_count(c, F.lit(_java(s.pattern)))
        if not s.gate:
            return n
        some = low.contains(s.gate[0])
        for g in s.gate[1:]:
            some = some | low.contains(g)
        return F.when(some, n).otherwise(0)

    extra = (mixed_script_words(c), base64_readable(c).cast("int"), F.coalesce((repetition_ratio(c) > 0.3).cast("int"), F.lit(0)))
    counts = F.array(*(F.coalesce(x, F.lit(0)).cast("long") for x in (*map(gated, (*ADVERSARIAL, *EVASION)), *extra)))
    # not deterministic on paper, so that the planner neither repeats the patterns for each use of a count nor
    # moves them into filters on scores and levels
    return F.when(F.monotonically_increasing_id() >= 0, counts)


def _findings(counts: Column) -> Column:
    """Array of struct(technique, category, severity, confidence, n) of one text, in a fixed order."""
    out = []
    for i, s in enumerate((*ADVERSARIAL, *EVASION)):
        n = counts[i]
        severity = F.when(n > s.many, "high").otherwise(s.severity) if s.many else F.lit(s.severity)
        out.append(_finding(s.technique, s.category, severity, F.least(F.lit(s.base) + s.step * n, F.lit(s.cap)) if s.step else F.lit(s.base), n))
    words, encoded, stuffed = (counts[len(out) + k] for k in range(3))
    out.append(_finding("homoglyph-mixed-script", "obfuscation", F.when(words > 3, "high").otherwise("medium"), F.least(60 + 10 * words, F.lit(95)), words))
    out.append(_finding("base64-readable", "obfuscation", F.lit("medium"), F.lit(65), encoded))
    out.append(_finding("context-stuffing", "adversarial", F.lit("medium"), F.lit(75), stuffed))
    return F.filter(F.array(*out), lambda x: x["n"] > 0)


def severity_rank(c: Column) -> Column:
    """1 for low to 4 for critical; 0 for anything else, null included."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), c), F.lit(0)).cast("int")


def severity_at(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.greatest(rank, F.lit(1)))


def risk(found: Column) -> tuple[Column, Column]:
    """(score, level) of an array of findings: weighted confidences up to 100; the worst severity or the score's threshold."""
    weights = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    score = F.least(F.lit(100), F.round(F.aggregate(found, F.lit(0.0), lambda a, x: a + weights[x["severity"]] * x["confidence"] / 100.0))).cast("long")
    worst = F.aggregate(found, F.lit(0), lambda a, x: F.greatest(a, severity_rank(x["severity"])))
    by_score = F.when(score >= 60, 3).when(score >= 25, 2).otherwise(1)
    return score, severity_at(F.greatest(worst, by_score))


def action(level: Column, actions: dict[str, str] = ACTIONS) -> Column:
    return F.create_map(*(F.lit(x) for kv in actions.items() for x in kv))[level]


def scan(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``findings``, ``score``, ``level`` and ``action``; null texts have no findings."""
    counted = spread(df).withColumn("_counts", _counts(F.col(text_col)))
    score, level = risk(F.col("findings"))
    found = counted.withColumn("findings", _findings(F.col("_counts"))).drop("_counts")
    return found.withColumns({"score": score, "level": level}).withColumn("action", action(F.col("level")))


def match_patterns(df: DataFrame, text_col: str, patterns: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """One row a text and pattern that occurs in it: the columns of ``df``, label, severity, sample (200 characters)."""
    found = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(severity).alias("severity"), F.regexp_extract(text_col, _java(p), 0).alias("sample")) for label, severity, p in patterns))
    rows = df.where(F.col(text_col).isNotNull()).select("*", F.explode(F.filter(found, lambda x: x["sample"] != "")).alias("_x"))
    clip = F.when(F.length("_x.sample") > 200, F.concat(F.left("_x.sample", F.lit(197)), F.lit("..."))).otherwise(F.col("_x.sample"))
    return rows.select(*df.columns, "_x.label", "_x.severity", clip.alias("sample"))


def unknown_fields(description: Column, known: Column) -> Column:
    """Fields a description mentions that ``known`` (an array) lacks; none where nothing is known."""
    mentioned = F.array_distinct(F.regexp_extract_all(description, F.lit(_java(MENTIONED_FIELD)), 1))
    return F.when(F.size(known) > 0, F.array_except(mentioned, known)).otherwise(F.filter(mentioned, lambda x: F.lit(False)))


def connector_risk(severities: Column) -> tuple[Column, Column, Column]:
    """(score, worst severity, action) of an array of severities; no findings are 0, low and allowed."""
    weights = F.create_map(*(F.lit(x) for kv in CONNECTOR_WEIGHTS.items() for x in kv))
    score = F.aggregate(severities, F.lit(0), lambda a, x: a + F.coalesce(weights[x], F.lit(0)))
    worst = severity_at(F.aggregate(severities, F.lit(0), lambda a, x: F.greatest(a, severity_rank(x))))
    return score, worst, F.when(F.size(severities) == 0, "allowed").otherwise(action(worst, CONNECTOR_ACTIONS))


def worst_action(c: Column) -> Column:
    """Aggregate: the gravest of the actions."""
    order = F.array(*map(F.lit, CONNECTOR_ACTION_ORDER))
    return F.element_at(order, F.greatest(F.max(F.array_position(order, c)).cast("int"), F.lit(1)))


def name_risk(distance: Column) -> Column:
    """How suspicious a name is by its distance to the nearest approved one; null for an approved name."""
    return F.when(distance == 0, None).when(distance <= 2, "critical").when(distance <= 4, "high").otherwise("low")


def pdf_findings(content: Column) -> Column:
    """Findings in the bytes of a file; none where it does not start as a PDF does."""
    head = F.decode(content, "ISO-8859-1")
    launch, script = head.contains("/Launch"), head.rlike(PDF_SCRIPT)
    marks = (
        ("pdf-launch-action", launch, "critical", 92),
        ("pdf-javascript", script, "critical", 92),
        ("pdf-auto-navigation", head.rlike(PDF_AUTO) & ~launch & ~script, "low", 40),
        ("pdf-embedded-file", head.contains("/EmbeddedFile"), "high", 80),
        ("pdf-hidden-layers", head.contains("/OCProperties"), "medium", 60),
    )
    found = F.array(*(_finding(name, "steganography", F.lit(severity), F.lit(sure), (head.startswith("%P") & hit).cast("int")) for name, hit, severity, sure in marks))
    return F.filter(found, lambda x: x["n"] > 0)
