"""Scalar functions over entity columns, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.wordlists import CALL_PREFIXES, DOMAIN_TERMS, ID_PREFIX_BY_KIND, PLAIN_TERMS



def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _py_repr(c: Column) -> Column:
    """Python's repr of a string for plain ones and for those with quotes, backslashes, tabs or line ends."""
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, seen in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(seen))
    single, double = F.contains(c, F.lit("'")), F.contains(c, F.lit('"'))
    return (
        F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"')))
        .when(single, F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
        .otherwise(F.concat(F.lit("'"), body, F.lit("'")))
    )


def entity_id(kind: Column, compound: Column, second: Column) -> Column:
    """prefix:first seven hex digits of the SHA-256 of the pair's repr (FN1)."""
    prefix = F.coalesce(F.create_map(*[F.lit(x) for kv in ID_PREFIX_BY_KIND.items() for x in kv])[kind], F.lit("sym"))
    pair = F.concat(F.lit("("), _py_repr(compound), F.lit(", "), _py_repr(second), F.lit(")"))
    return F.concat(prefix, F.lit(":"), F.substring(F.sha2(pair, 256), 1, 7))


def shape_rank(raw: Column, ceiling: Column | float) -> Column:
    """log1p share of the ceiling, at most 1; 0 for a ceiling of 0 or less (FN6)."""
    top = ceiling if isinstance(ceiling, Column) else F.lit(float(ceiling))
    return F.when(top <= 0, F.lit(0.0)).otherwise(F.least(F.log1p(raw) / F.log1p(top), F.lit(1.0)))


def is_symbol_like(query: Column) -> Column:
    """No blank inside, or a call parenthesis; blank queries are not (FN7)."""
    q = F.trim(query)
    return (q != "") & (F.contains(q, F.lit("(")) | ~F.contains(q, F.lit(" ")))


def scope_split(query: Column) -> Column:
    """struct(scope, bare) at the last `::`, both halves trimmed and not blank; else null scope (FN8)."""
    scope = F.trim(F.regexp_extract(query, r"(?s)^(.*)::(.*)$", 1))
    bare = F.trim(F.regexp_extract(query, r"(?s)^(.*)::(.*)$", 2))
    ok = (scope != "") & (bare != "")
    return F.struct(F.when(ok, scope).alias("scope"), F.when(ok, bare).otherwise(F.trim(query)).alias("bare"))


def symbol_searchable(name: Column, qualified: Column, signature: Column) -> Column:
    """Lower-cased name, qualified name and signature without `* & ( ) , ;` (FN9)."""
    joined = F.concat_ws(" ", blank_to_null(name), blank_to_null(qualified), blank_to_null(signature))
    return F.regexp_replace(F.lower(joined), r"[*&(),;]", "")


def doc_embed_text(brief, details, params, returns, notes, rationale, name) -> Column:
    """Labelled documentation fields, one a line; the name where there are none (FN10)."""
    listed = F.array_join(F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    parts = [("BRIEF", brief), ("DETAILS", details), ("PARAMS", listed), ("RETURNS", returns), ("NOTES", notes), ("RATIONALE", rationale)]
    lines = [F.when(blank_to_null(v).isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in parts]
    return F.coalesce(blank_to_null(F.concat_ws("\n", *lines)), name)


def symbol_embed_text(kind: Column, name: Column, qualified: Column, signature: Column) -> Column:
    """A scoped function's signature with its first plain name replaced by the qualified one (FN11)."""
    at = F.instr(signature, name)
    scoped = F.concat(F.substr(signature, F.lit(1), at - 1), qualified, F.substr(signature, at + F.length(name)))
    is_call = kind == "function"
    full = F.coalesce(blank_to_null(qualified), name)
    return (
        F.when(is_call & F.contains(full, F.lit("::")) & (at > 0), scoped)
        .when(is_call, F.coalesce(blank_to_null(signature), full))
        .otherwise(full)
    )


def minimal_embed_text(kind: Column, name: Column, signature: Column, path: Column) -> Column:
    """Kind tag, name or signature and file; null if all are empty (FN12)."""
    shown = F.coalesce(blank_to_null(signature), blank_to_null(name))
    tagged = F.when(blank_to_null(kind).isNotNull() & shown.isNotNull(), F.concat(F.lit("["), kind, F.lit("] "), shown)).otherwise(shown)
    return blank_to_null(F.concat_ws(" ", tagged, F.when(blank_to_null(path).isNotNull(), F.concat(F.lit("in "), path))))


def is_entry_point(kind: Column, name: Column) -> Column:
    """A function named with a call prefix (FN13)."""
    by_name = F.lit(False)
    for p in CALL_PREFIXES:
        by_name = by_name | F.startswith(name, F.lit(p))
    return F.coalesce((kind == "function") & by_name, F.lit(False))


def entry_type(name: Column, words: bool = False) -> Column:
    """The call prefix, or its word (FN14)."""
    out = F.lit(None).cast("string")
    for p, w in reversed(CALL_PREFIXES.items()):
        out = F.when(F.startswith(name, F.lit(p)), w if words else p).otherwise(out)
    return out


def bare_name(signature: Column) -> Column:
    """The function's name of a full signature: before `(`, after the last blank (FN15)."""
    at = F.instr(signature, F.lit("("))
    head = F.when(at > 1, F.substr(signature, F.lit(1), at - 1)).otherwise(signature)
    return F.when(F.rtrim(head) != "", F.substring_index(head, " ", -1)).otherwise(head)


def entry_point_name(signature: Column) -> Column:
    """From the first call prefix inside a signature up to its parenthesis; else the signature (FN15)."""
    out = signature
    for p in reversed(CALL_PREFIXES):
        at = F.instr(signature, F.lit(p))
        out = F.when(at > 0, F.substring_index(F.substr(signature, at), "(", 1)).otherwise(out)
    return out


def rationale_specificity(text: Column) -> Column:
    """min(length / 500, 1) (0.5 + 0.5 share of domain terms among the words), to four places (FN16)."""
    found = F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
    share = F.size(F.array_intersect(found, F.array(*[F.lit(t) for t in DOMAIN_TERMS]))) / F.greatest(F.size(found), F.lit(1))
    return F.when(blank_to_null(F.trim(text)).isNull(), F.lit(0.0)).otherwise(
        F.round(F.least(F.length(text) / 500.0, F.lit(1.0)) * (0.5 + 0.5 * share), 4)
    )


def contract_seed(fan_in: Column, rationale: Column) -> Column:
    """Called from more than ten places and with a rationale (FN16)."""
    return F.coalesce((fan_in > 10) & blank_to_null(rationale).isNotNull(), F.lit(False))


def name_terms(name: Column) -> Column:
    """Terms of a camel-case or separated name, without plain programming terms and short ones (FN18)."""
    snake = F.lower(F.regexp_replace(name, r"(?<!^)(?=[A-Z])", "_"))
    return F.filter(F.split(snake, r"[_\s\-.]"), lambda w: (F.length(w) > 2) & ~w.isin(*PLAIN_TERMS))


def clean_text(text: Column) -> Column:
    """Lower case, fenced code and punctuation out, blanks squeezed (FN19)."""
    out = F.regexp_replace(F.lower(text), r"(?s)```.*?```", " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def function_name(definition: Column) -> Column:
    """The possibly scoped name of a definition, without return type and parameters (FN20)."""
    return F.regexp_extract(definition, r"((?:~?[A-Za-z_]\w*::)*~?[A-Za-z_]\w*)\s*(?:\(|$)", 1)


def dependency_summary(kind: Column, name: Column, brief: Column) -> Column:
    """`- kind name: brief` for a prompt's context (FN21)."""
    return F.concat_ws(": ", F.concat(F.lit("- "), F.concat_ws(" ", kind, name)), blank_to_null(brief))


def qualified_kind_name(kind: Column, qualified: Column, signature: Column) -> Column:
    return F.concat_ws(" ", kind, F.concat(F.coalesce(blank_to_null(qualified), F.lit("")), F.coalesce(signature, F.lit(""))))


def has_documentation(response: Column, brief: Column, details: Column) -> Column:
    """A complete document has a response, or a brief and details (FN23)."""
    return blank_to_null(response).isNotNull() | (blank_to_null(brief).isNotNull() & blank_to_null(details).isNotNull())


def utility_score(parts: dict[str, tuple[Column, float]]) -> Column:
    """Product of normalised metrics to the power of their weights (FN26)."""
    out = F.lit(1.0)
    for value, weight in parts.values():
        out = out * F.pow(value, F.lit(weight))
    return out


def like_contains(column: Column, text: Column) -> Column:
    """ILIKE %text%: wildcards in the text stay wildcards."""
    return F.ilike(column, F.concat(F.lit("%"), text, F.lit("%")))


def like_prefix(column: Column, text: Column) -> Column:
    """LIKE text%: wildcards in the text stay wildcards."""
    return F.like(column, F.concat(text, F.lit("%")))
