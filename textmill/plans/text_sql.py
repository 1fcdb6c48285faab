"""DuckDB SQL of the composed text operators: normalization, rule detection, verdicts and privacy masks.

RE2 has no lookarounds: a pattern that wants its neighbours left alone takes them as groups and puts them back, twice or over
doubled neighbours, as one match may take the neighbour that the next needs. Compatibility forms (NFKC) are taken as composed ones (NFC), which holds for
texts of Western European letters.
"""

from __future__ import annotations

from textmill.functions import fixed_values as V
from textmill.functions.normalize import Maps, ordered
from textmill.plans.base import LEXICONS, MAPS, RULES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def twice(t: str, pattern: str, put: str) -> str:
    for _ in range(2):
        t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(put)}, 'g')"
    return t


def unicode_form(t: str) -> str:
    return rf"regexp_replace(nfc_normalize(regexp_replace({t}, '^\s+|\s+$', '', 'g')), '[\p{{Cc}}\p{{Cf}}]', '', 'g')"


def lower_case(t: str) -> str:
    return f"array_to_string([lower(x) for x in string_split({t}, 'C++')], 'C++')"


def mapped(t: str, entries) -> str:
    for s, to in ordered(entries):
        t = f"replace({t}, {quoted(s)}, {quoted(to)})"
    return t


def tokens_mapped(t: str, entries) -> str:
    for s, to in ordered(entries):
        t = twice(t, f"(^|[^a-zA-Z0-9]){s}($|[^a-zA-Z0-9])", rf"\1{to}\2")
    return t


_MAIL_CHARS = "A-Za-z0-9._%+-"
_MAIL = rf"(^|[^@{_MAIL_CHARS}])([{_MAIL_CHARS}]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}})($|[^@{_MAIL_CHARS}])"
#: A letter that stands for an address meanwhile, and a mark before it where the address doesn't begin with a letter or digit.
_HELD, _MARK = "ꙮ", "\ue000"
_NOISE = "".join("\\" + c if c in "\\^-]" else c for c in V.NOISE)
#: White space as (?U)\s has it.
_BLANK = r"[\t-\r\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def doubled(t: str, neighbours: str) -> str:
    """Each character of a class twice: a match takes one as its neighbour and leaves the other to the next match."""
    return f"regexp_replace({t}, {quoted(f'({neighbours})')}, {quoted(chr(92) + '1' + chr(92) + '1')}, 'g')"


def undoubled(t: str, neighbours: str) -> str:
    return f"regexp_replace({t}, {quoted(f'({neighbours}){neighbours}')}, {quoted(chr(92) + '1')}, 'g')"


def without_noise(t: str) -> str:
    other = f"[^@{_MAIL_CHARS}]"
    wide = doubled(t, other)
    held = f"regexp_replace({wide}, {quoted(_MAIL.replace(f'([{_MAIL_CHARS}]+@', f'([A-Za-z0-9][{_MAIL_CHARS}]*@'))}, {quoted(chr(92) + '1' + 2 * _HELD + chr(92) + '3')}, 'g')"
    held = f"regexp_replace({held}, {quoted(_MAIL)}, {quoted(chr(92) + '1' + 2 * _MARK + 2 * _HELD + chr(92) + '3')}, 'g')"
    kept = twice(undoubled(held, other), rf"([\p{{L}}\p{{N}}])[{_NOISE}]([\p{{L}}\p{{N}}])", r"\1\2")
    kept = f"replace({twice(kept, f'([一-鿿]){_BLANK}([一-鿿])', chr(92) + '1' + chr(92) + '2')}, '{_MARK}', '')"
    return f"array_to_string(list_transform(list_zip(string_split({kept}, '{_HELD}'), regexp_extract_all({wide}, {quoted(_MAIL)}, 2)), lambda p: p[1] || coalesce(p[2], '')), '')"


def cut_repeats(c: str) -> str:
    """Over a column that holds the text's characters as a list."""
    return f"array_to_string(list_filter({c}, lambda x, i: not coalesce(i > 2 and {c}[i - 1] = x and {c}[i - 2] = x, false)), '')"


STEPS = ("unicode", "case", "emoji", "symbol_insertion", "noise_char", "repeat_char", "variant_char", "homophone", "pinyin", "abbreviation", "noise_char")


def normalized(source: str, text: str = "text", out: str = "n", maps: Maps = MAPS) -> str:
    """CTEs {out}0 ... {out}: the relation `source` with the text after each step, {out}_t1 ... {out}_t11."""
    steps = [unicode_form, lower_case, lambda t: mapped(t, maps.emoji), lambda t: mapped(t, maps.symbol), without_noise, None, lambda t: mapped(t, maps.variant), lambda t: mapped(t, maps.homophone), lambda t: tokens_mapped(t, maps.pinyin), lambda t: tokens_mapped(t, maps.abbreviation), without_noise]
    ctes, at, column = [], source, text
    for i, step in enumerate(steps, 1):
        if step is None:
            ctes.append(f"{out}c as (select *, regexp_extract_all({column}, '(?s).') as {out}_c from {at})")
            at, made = f"{out}c", cut_repeats(f"{out}_c")
        else:
            made = step(column)
        name = out if i == len(steps) else f"{out}{i}"
        kept = " materialized" if name == out else ""
        ctes.append(f"{name} as{kept} (select *, {made} as {out}_t{i} from {at})")
        at, column = name, f"{out}_t{i}"
    return ",\n".join(ctes)


def found(relation: str, text: str, out: str, key: str = "doc_id") -> str:
    """CTE {out}: a row a (key, detection) of the rule pack on a text column: seq, category, source, score, matches."""
    words = [(c, s, 80 if c in ("porn", "violence") else 55) for s, c in enumerate(sorted(LEXICONS))]
    parts = [f"select {key}, {s} as seq, '{c}' as category, 'keyword' as source, {score} as score, list_filter({'[' + ', '.join(map(quoted, LEXICONS[c])) + ']'}, lambda w: contains({text}, w)) as matches from {relation} where {text} is not null" for c, s, score in words]
    parts += [f"select {key}, {len(words) + i}, '{c}', 'regex', {score}, list_distinct(regexp_extract_all({text}, {quoted(p)}, 0, 'i')) from {relation} where {text} is not null" for i, (c, p, _, score, _) in enumerate(RULES)]
    return f"{out} as (select * from ({' union all '.join(parts)}) where len(matches) > 0)"


def verdict(relation: str, text: str = "text", key: str = "doc_id") -> str:
    """CTEs up to `v`: the input verdict of each row: first (action), action, risk_score, risk_level, risk_categories, normalized, sanitized, again."""
    return ",\n".join([
        normalized(relation, text),
        found("n", "n_t11", "f", key),
        f"s as (select n.{key}, coalesce(max(score), 0)::INT as risk_score, coalesce(array_to_string(list_sort(list(distinct category) filter (category is not null)), ','), '') as risk_categories, count(f.score) as detections from n left join f using ({key}) group by n.{key})",
        f"m as (select {key}, list(word order by -length(word), place) as words from (select {key}, word, min(seq * 1000 + i) as place from (select {key}, seq, unnest(matches) as word, generate_subscripts(matches, 1) as i from f) group by 1, 2) group by 1)",
        f"w as (select n.{key}, n_t11, s.* exclude ({key}), case when risk_score >= 40 and risk_score < 80 then list_reduce(list_concat([n_t11], coalesce(words, [])), lambda a, x: replace(a, x, {quoted(V.MATCH_MASK)})) end as rewritten from n join s using ({key}) left join m using ({key}))",
        normalized("w", "rewritten", "o"),
        found("o", "o_t11", "f2", key),
        f"again as (select {key}, count(*) as n_again from f2 group by 1)",
        f"""v as materialized (select o.{key}, risk_score, risk_categories, detections, n_t11 as normalized, rewritten, case when rewritten is not null then coalesce(n_again, 0) end as again,
 case when n_again > 0 then 'block' when risk_score >= 80 then 'block' when risk_score >= 40 then 'sanitize' else 'pass' end as action,
 case when n_again > 0 then 'high' when risk_score >= 80 then 'high' when risk_score >= 40 then 'medium' when risk_score > 0 then 'low' else 'none' end as risk_level,
 case when n_again is null then rewritten end as sanitized from o left join again using ({key}))""",
    ])


_OTHER = r"\P{Nd}"
#: The privacy patterns for RE2, over texts whose characters other than digits stand doubled: neighbours are taken and put back.
_EDGED = {
    "phone": r"(^|\P{Nd})(?:(?:(?:\+\+)?86(?:--|  )?)?1[3-9]\p{Nd}{9})($|\P{Nd})",
    "id_card": r"(^|\P{Nd})(?:\p{Nd}{17}(?:\p{Nd}|XX|xx))($|\P{Nd})",
    "bank_card": r"(^|\P{Nd})(?:(?:\p{Nd}(?:  |--)?){16,19})($|\P{Nd})",
}


def privacy(relation: str, text: str = "text", out: str = "p") -> str:
    """CTEs up to {out}: the masked text, {out}_masked, and the names of the rules that changed it, {out}_names."""
    ctes, at, column = [], relation, text
    for i, (name, pattern, mask) in enumerate(V.PRIVACY):
        if name in _EDGED:
            put = "\\1" + "".join(2 * c for c in mask) + "\\2"
            made = undoubled(f"regexp_replace({doubled(column, _OTHER)}, {quoted(_EDGED[name])}, {quoted(put)}, 'g')", _OTHER)
        else:
            flags = "(?i)" if pattern.startswith("(?i") else ""
            made = f"regexp_replace({column}, {quoted(flags + (pattern[pattern.index(')') + 1 :] if pattern.startswith('(?U') or pattern.startswith('(?iU') else pattern))}, {quoted(mask)}, 'g')"
        ctes.append(f"{out}{i} as (select *, {made} as {out}_m{i} from {at})")
        at, column = f"{out}{i}", f"{out}_m{i}"
    before = [text, *(f"{out}_m{i}" for i in range(len(V.PRIVACY)))]
    names = ", ".join(f"case when {before[i]} <> {before[i + 1]} then '{name}' end" for i, (name, _, _) in enumerate(V.PRIVACY))
    ctes.append(f"{out} as (select *, {column} as {out}_masked, concat_ws(',', {names}) as {out}_names from {at})")
    return ",\n".join(ctes)


def refusal(categories: str) -> str:
    """Over a list of categories."""
    table = "map {" + ", ".join(f"'{k}': {quoted(v)}" for k, v in V.REFUSALS.items()) + "}"
    return f"case when len({categories}) > 1 then {quoted(V.REFUSALS['mixed'])} when len({categories}) = 0 then {quoted(V.REFUSAL_GENERIC)} else coalesce({table}[{categories}[1]], {quoted(V.REFUSALS['mixed'])}) end"


def guard(relation: str, text: str, out: str, key: str = "doc_id") -> str:
    """CTEs up to {out}: the output guard without a second look, of rows whose text isn't null: {out}_action, _score, _level, _cats (a list), _final, _normalized, _names."""
    n, rewritten = f"{out}n", f"{out}p_masked"
    for c in sorted(LEXICONS):
        for w in sorted(LEXICONS[c], key=lambda w: -len(w)):
            rewritten = f"case when list_contains({out}_words, {quoted(w)}) then replace({rewritten}, {quoted(w)}, {quoted('[已过滤:' + V.CATEGORY_LABELS.get(c, c) + ']')}) else {rewritten} end"
    return ",\n".join([
        normalized(f"(select * from {relation} where {text} is not null)", text, n),
        found(n, f"{n}_t11", f"{out}f", key),
        privacy(n, text, f"{out}p"),
        f"{out}k as (select {key}, max(score) as score, list(distinct category) as cats, list_distinct(flatten(list(matches) filter (source = 'keyword'))) as words from {out}f group by {key})",
        f"""{out}j as (select {out}p.*, greatest(coalesce(score, 0), case when {out}p_names <> '' then 45 else 0 end)::INT as {out}_score, coalesce(words, []) as {out}_words,
 list_sort(list_concat(coalesce(cats, []), case when {out}p_names <> '' then ['privacy'] else [] end)) as {out}_cats, {out}p_names as {out}_names, case when {n}_t11 = '' then {text} else {n}_t11 end as {out}_normalized from {out}p left join {out}k using ({key}))""",
        f"""{out}a as (select *, case when {out}_score >= 80 then 'block' when {out}_score >= 40 or {out}_names <> '' then 'sanitize' else 'pass' end as {out}_action,
 case when {out}_score >= 80 then 'high' when {out}_score >= 40 then 'medium' when {out}_score > 0 then 'low' else 'none' end as {out}_level, {rewritten} as {out}_rewrite from {out}j)""",
        f"""{out} as materialized (select *, case when {out}_action = 'block' then {refusal(out + '_cats')} when {out}_action = 'pass' then {text}
 when regexp_replace({out}_rewrite, '\\s+', '', 'g') = '' or {out}_rewrite = {text} then {quoted(V.REWRITE_GENERIC)} else {out}_rewrite end as {out}_final from {out}a)""",
    ])


def guarded(relation: str, text: str, key: str = "doc_id") -> str:
    """CTEs up to `gg`: the output guard with its second look: action, rechecked, rewritten, cats (a list), final."""
    return ",\n".join([
        guard(relation, text, "g", key),
        "h as (select *, case when g_action = 'sanitize' then g_final end as h_text from g)",
        guard("h", "h_text", "b", key),
        f"bb as (select {key}, b_action, b_cats from b)",
        f"""ff as (select h.*, b_action, b_action is not null and b_action <> 'pass' as failed, list_sort(list_distinct(list_concat(g_cats, coalesce(b_cats, [])))) as all_cats from h left join bb using ({key}))""",
        f"""gg as materialized (select *, case when failed then 'block' else g_action end as action, g_action = 'sanitize' as rewritten, case when g_action = 'sanitize' then b_action end as rechecked,
 case when failed then all_cats else g_cats end as cats, case when failed then {refusal('all_cats')} else g_final end as final from ff)""",
    ])
