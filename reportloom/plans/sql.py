"""SQL of the text functions for the checking engine, which has no look-around: a mark is put where a text is cut instead."""

from __future__ import annotations

from reportloom.functions.text import DEPENDENCY_CUES

BULLET = r"\s*(?:[-*•]|\d+[.)])\s+"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def line(x: str) -> str:
    """T1."""
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def keep(x: str) -> str:
    """T2."""
    return strip(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({strip(x)}, '\r\n?', chr(10), 'g'), '[\x{{200b}}-\x{{200d}}\x{{feff}}]', '', 'g'), '[ \t]+', ' ', 'g'), '\n\n\n+', chr(10) || chr(10), 'g')")


def augmented(x: str) -> str:
    """T18."""
    return rf"regexp_replace({keep(x)}, '\n\n+', chr(10), 'g')"


def breaks(t: str) -> str:
    """T19, of a text in the form T18."""
    return f"(contains({t}, chr(10)) OR regexp_matches({t}, '^{BULLET}'))"


def listed(t: str) -> str:
    """T10, of a text in the form T2."""
    return f"regexp_matches({t}, '(?m)^{BULLET}')"


def items(t: str) -> str:
    """T10, of a text in the form T2."""
    lines = rf"list_filter(list_transform(regexp_split_to_array({t}, '[\n\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {strip('x')}), lambda x: x <> '')"
    return f"list_filter(list_transform({lines}, lambda x: CASE WHEN regexp_matches(x, '^{BULLET}') THEN {strip(f'''regexp_replace(x, '^{BULLET}', '')''')} ELSE x END), lambda x: x <> '')"


def sentences(t: str) -> str:
    """T11, of a text in the form T2."""
    marked = rf"regexp_replace({t}, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g')"
    parts = rf"list_filter(list_transform(regexp_split_to_array({marked}, '\x01|\n+'), lambda x: {keep('x')}), lambda x: x <> '')"
    return f"CASE WHEN {t} = '' THEN []::VARCHAR[] WHEN {listed(t)} THEN {items(t)} WHEN len({parts}) = 0 THEN [{t}] ELSE {parts} END"


def without_period(x: str) -> str:
    return strip(rf"regexp_replace({strip(x)}, '\.+$', '')")


def with_period(x: str) -> str:
    return f"CASE WHEN {strip(x)} = '' OR regexp_matches({strip(x)}, '[.!?]$') THEN {strip(x)} ELSE {strip(x)} || '.' END"


def join(parts: str, style: int) -> str:
    """T12, of sentences in the form T2, none empty."""
    joined = {
        0: f"array_to_string({parts}, ' ')", 1: f"array_to_string(list_transform({parts}, lambda x: {with_period(without_period('x'))}), ' ')",
        2: f"array_to_string(list_transform({parts}, lambda x: {without_period('x')}), '; ') || '.'", 3: f"array_to_string(list_transform({parts}, lambda x: '- ' || {without_period('x')}), chr(10))",
    }[style]
    return f"CASE WHEN len({parts}) = 0 THEN '' ELSE {joined} END"


def can_shuffle(parts: str) -> str:
    """T14."""
    return rf"(len({parts}) >= 2 AND len(list_filter({parts}, lambda x: regexp_matches(x, '\b({'|'.join(DEPENDENCY_CUES)})\b', 'i'))) = 0)"


def merged(parts: str, least: int = 35) -> str:
    """T15."""
    cell = f"list_transform({parts}, lambda x: {{'done': []::VARCHAR[], 'held': x}})"
    pair = keep(rf"({without_period('a.held')} || '; ' || regexp_replace(b.held, '^\s+', ''))")
    step = f"CASE WHEN a.held IS NULL THEN {{'done': a.done, 'held': b.held}} WHEN length(a.held) < {least} OR length(b.held) < {least} THEN {{'done': list_append(a.done, {pair}), 'held': NULL}} ELSE {{'done': list_append(a.done, a.held), 'held': b.held}} END"
    folded = f"list_reduce({cell}, lambda a, b: {step}, {{'done': []::VARCHAR[], 'held': NULL::VARCHAR}})"
    return f"list_transform([{folded}], lambda r: CASE WHEN r.held IS NULL THEN r.done ELSE list_append(r.done, r.held) END)[1]"


def rand(key: str, seed: int) -> str:
    """M9: select.det_rand."""
    a = f"(({key} * 2654435761 + {seed * 40503 + 12345}) % 2147483647)"
    b = f"(({a} * {a} + 69621) % 2147483647)"
    return f"((({b} * {b}) + 48271) % 2147483647) / 2147483647.0::DOUBLE"


def drawn(parts: str, key: str, seed: int) -> str:
    """augment.in_drawn_order."""
    place = f"({key} * 64 + i - 1)"
    return f"list_transform(list_sort(list_transform({parts}, lambda x, i: {{'u': {rand(place, seed)}, 'i': i, 'x': x}})), lambda e: e.x)"


def changed(source: str, text: str, key: str, seed: int = 42) -> str:
    """T16 as a query: all columns of source, and `changed`: the text after one change. key: an expression over source's columns."""
    mixed = f"CASE WHEN NOT {can_shuffle('_s')} THEN '' WHEN _style = 0 THEN {join('_p', 0)} WHEN _style = 1 THEN {join('_p', 1)} ELSE {join('_p', 2)} END"
    one = f"SELECT *, {keep(text)} AS _t, ({key}) AS _k FROM {source}"
    two = f"SELECT *, {sentences('_t')} AS _s, {listed('_t')} AS _l, floor({rand('(_k * 64 + 62)', seed)} * 3) AS _style FROM ({one})"
    three = f"SELECT *, {drawn('_s', '_k', seed)} AS _d FROM ({two})"
    four = f"SELECT *, CASE WHEN {rand('(_k * 64 + 61)', seed)} < 0.35 THEN {merged('_d')} ELSE _d END AS _p FROM ({three})"
    paragraph = f"CASE WHEN NOT _l THEN '' WHEN len({items('_t')}) = 0 THEN _t ELSE {join(items('_t'), 1)} END"
    listing = f"CASE WHEN _l THEN '' WHEN len(_s) < 2 THEN _t ELSE {join('_s', 3)} END"
    points = r"regexp_replace(_t, '\s+([,.;])', '\1', 'g')"
    five = f"SELECT *, [{', '.join(keep(f'({x})') for x in (mixed, paragraph, listing, points))}] AS _made FROM ({four})"
    six = f"SELECT *, list_filter({drawn('_made', '_k', seed + 1)}, lambda y: y <> '' AND y <> _t) AS _new FROM ({five})"
    return f"SELECT * EXCLUDE (_t, _k, _s, _l, _style, _d, _p, _made, _new), CASE WHEN len(_new) = 0 THEN _t ELSE _new[1] END AS changed FROM ({six})"
