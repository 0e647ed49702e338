"""SQL twins of the entity rules: the same patterns without look-around, for DuckDB's regular expressions."""

from __future__ import annotations

from docketspark.functions import checksums as ck
from docketspark.operators import entities as en

_S = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LEFT, _RIGHT = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
_N = r"\d{1,5}/\d{2,4}\b"


def _in_sql(pattern: str) -> str:
    return pattern.replace(r"\s", _S).replace("'", "''")


def _sum(weights: tuple[int, ...], v: str = "x") -> str:
    return " + ".join(f"{w} * CAST(substring({v}, {i}, 1) AS INTEGER)" for i, w in enumerate(weights, 1))


_CODE = "[A-Z](?:|[a-z][A-Za-z]{0,2}|[A-Z][a-z][A-Za-z]?|[A-Z]{2}[a-z])"  # no two to four capitals only
#: A form's end is not consumed, so that another company may follow at once.
_FORMS = "|".join(en.form_pattern(f) + (r"\b" if f[-1].isascii() and f[-1].isalpha() else r"\B") for f in sorted(en.LEGAL_FORMS, key=len, reverse=True))
_MARKERS = en._MARKERS
_W = r"\p{L}\p{N}_"

#: Rule -> (pattern, group).
PATTERNS: dict[str, tuple[str, int]] = {
    "pesel-11-digits-checksum": (r"\b\d{11}\b", 0),
    "nip-10-digits-checksum": (r"\b\d{3}[- ]?\d{3}[- ]?\d{2}[- ]?\d{2}\b", 0),
    "regon-9-or-14-checksum": (r"\b(?:\d{14}|\d{9})\b", 0),
    "krs-with-prefix": (rf"\bKRS(?:[:]|{_S})*(\d{{10}})\b", 1),
    "email-pragmatic": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0),
    "phone-pl-with-prefix": (rf"\+48(?:{_S}|-)?\d{{3}}(?:{_S}|-)?\d{{3}}(?:{_S}|-)?\d{{3}}\b", 0),
    "signature-sn": (rf"\b(?:I{{1,3}}|IV|V|VI|VII){_S}+[A-Z]{{2,4}}{_S}+{_N}", 0),
    "signature-nsa": (rf"\b(?:I|II|III){_S}+(?:{'|'.join(en.NSA_CODES)}){_S}+{_N}", 0),
    "signature-wsa": (rf"\b(?:I|II|III|IV){_S}+SA/[A-Z][a-z]{{1,2}}{_S}+{_N}", 0),
    "signature-kio": (rf"\bKIO(?:/UZP)?{_S}+{_N}", 0),
    "signature-tk": (rf"\b(?:{'|'.join(en.TK_CODES)}){_S}+\d{{1,4}}/\d{{2,4}}\b", 0),
    "signature-sad-powszechny": (rf"\b{en.ROMAN_1_39}{_S}+{_CODE}{_S}+{_N}", 0),
    "celex-eu-act": (r"\b3\d{4}[RLDQ]\d{4}\b", 0),
    "eli-pl-act": (r"(?i)eli/(?:sejm|mp|powszechnie|akty-prawne)/[a-z]+/\d{4}/\d+/?\d*", 0),
    "firma-z-forma-prawna": (rf"{_LEFT}([{en._CAP}](?:[A-Za-z0-9_ĄĆĘŁŃÓŚŹŻąćęłńóśźż.,&-]|{_S}){{0,80}}?{_S}+(?i:{_in_sql(_FORMS)}))", 1),
    "osoba-z-markerem": (rf"{_LEFT}(?:{_in_sql(_MARKERS)}){_S}+([{en._CAP}][{en._LOW}]+(?:(?:-|{_S})[{en._CAP}][{en._LOW}]+){{0,2}})", 1),
    "copy-kwota-pl": (rf"(\d{{1,3}}(?:[\x{{a0}} .]\d{{3}})*(?:,\d{{1,2}})?[\x{{a0}} ](?:{en._MONEY}))(?:{_S}|$|[.,;:!?)\]])", 1),
    "copy-data-iso": (r"\b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b", 0),
    "copy-data-kropka": (r"\b(?:0?[1-9]|[12]\d|3[01])\.(?:0?[1-9]|1[0-2])\.\d{4}\b", 0),
    "copy-data-slowna": (rf"\b(?:0?[1-9]|[12]\d|3[01]){_S}+(?:{en._MONTHS}){_S}+\d{{4}}(?:{_S}+r\.|{_S}+roku)?", 0),
    "act": (rf"{_LEFT}((?i:{'|'.join(sorted(en.ACTS, key=len, reverse=True))})){_RIGHT}", 1),
    "article": (rf"(?i)art\.{_S}*\d+[a-z]?(?:{_S}*ust\.{_S}*\d+)?", 0),
    "street": (rf"(?i:\b(?:ul\.|ulica|al\.|aleja|alei|pl\.|plac|os\.|osiedle)){_S}+[{en._CAP}0-9][{_W}.\- ]{{1,50}}?{_S}+\d+[A-Za-z]?(?:{_S}*/{_S}*\d+[A-Za-z]?)?\b", 0),
    "postal": (r"\b\d{2}-\d{3}\b", 0),
}

_DIGITS = "regexp_replace(x, '[ -]', '', 'g')"
#: What makes a match of these rules valid.
VALID = {
    "pesel-11-digits-checksum": f"(10 - ({_sum(ck.PESEL)}) % 10) % 10 = CAST(right(x, 1) AS INTEGER)",
    "nip-10-digits-checksum": f"({_sum(ck.NIP, _DIGITS)}) % 11 = CAST(right(x, 1) AS INTEGER)",
    "regon-9-or-14-checksum": f"({_sum(ck.REGON9)}) % 11 % 10 = CAST(substring(x, 9, 1) AS INTEGER) AND (length(x) = 9 OR ({_sum(ck.REGON14)}) % 11 % 10 = CAST(right(x, 1) AS INTEGER))",
}

_KINDS = {r.rule_id: r.kind for r in en.RULES}
SIGNATURES = [k for k in PATTERNS if _KINDS[k] == "SYGNATURA_ORZECZENIA"]
RELATED = [k for k in PATTERNS if _KINDS[k] in en.RELATIONS]
RELATION = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN '{en.RELATIONS[_KINDS[k]]}'" for k in RELATED) + " END"


def _list(rule: str, text: str) -> str:
    pattern, group = PATTERNS[rule]
    found = f"regexp_extract_all({text}, '{pattern}', {group})"
    return f"list_filter({found}, lambda x: {VALID[rule]})" if rule in VALID else found


def counts(table: str, id_col: str, text: str) -> str:
    return " UNION ALL ".join(f"SELECT {id_col}, '{k}' AS rule_id, len({_list(k, text)}) AS n FROM {table}" for k in PATTERNS)


def matches(table: str, id_col: str, text: str, rules: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {id_col}, '{k}' AS rule_id, unnest({_list(k, text)}) AS value FROM {table}" for k in rules)


#: The cascade of entities.signature_prefix on column {v}.
PREFIX = (
    "coalesce(nullif(regexp_extract({v}, '^(?:I{{1,3}}|IV)" + _S.replace("{", "{{").replace("}", "}}") + "+SA/[A-Z][a-z]{{1,2}}\\b'), ''), nullif(regexp_extract({v}, '^KIO(?:/UZP)?\\b'), ''), "
    "nullif(regexp_replace(regexp_extract({v}, '^(?:I{{1,3}}|IV|V|VI|VII)\\s+[A-Z]{{2,4}}\\b'), '\\s+', ' '), ''), nullif(regexp_extract({v}, '^(?:"
    + "|".join(en.TK_CODES)
    + "|Tw)\\b'), ''), nullif(regexp_replace(regexp_extract({v}, '^"
    + (en.ROMAN_1_39 + r"\s+" + _CODE + r"\b").replace("{", "{{").replace("}", "}}")
    + "'), '\\s+', ' '), ''))"
)
