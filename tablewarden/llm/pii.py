"""Personal data replaced by format-preserving pseudonyms: keyed Feistel permutations within each value's own format.

Found and validated are e-mail addresses, telephone numbers, social security numbers, IPv4 addresses (octets to 255),
dates of 1700 to 2099 (year first, or day first), payment cards (Luhn), IBANs (mod 97) and quoted values of tokens,
keys and passwords. A number that fails its validation stays as it is.

Each kind is permuted on its own domain, so a pseudonym is again a valid value of the same length and look, different
values never get the same pseudonym, and equal values have equal ones in all documents. Texts, cards and the like are
permuted by character classes: the halves of the value take turns in being shifted, digit by digit and letter by letter,
by a keyed hash of the other half. Check digits are computed anew. Addresses and dates are numbers, permuted by a Feistel
network over two mixed-radix halves whose product is exactly the number of valid values.

Everything is Spark SQL functions; a text is searched only if it has a digit, ``@`` or ``=``. Null stays null; the
other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import fresh_name

ROUNDS = 8
DAYS = (189, 773)  # 400 years have 189 * 773 days
FIRST_DAY = "date'1700-01-01'"

PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?i:token|secret|api_?key|password)\s?[=:]\s?\"[A-Za-z0-9+/=_.-]{8,256}\"",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ -]?)?(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9])",
    "ymd": r"(?<![0-9-])[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}(?![0-9-])",
    "dmy": r"(?<![0-9./])[0-9]{2}([./])[0-9]{2}\2[0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
ANY = "|".join(PATTERNS.values())


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash(key: str, *parts: str) -> str:
    """A keyed 60-bit number from SQL texts."""
    return f"cast(conv(substring(sha2(concat_ws('|', {_quoted(key)}, {', '.join(parts)}), 256), 1, 15), 16, 10) as bigint)"


def _shift(key: str, kind: str, text: str, turn: str, other: str) -> str:
    """``text`` with each digit and letter moved within its class by a hash of ``other``."""
    k = _hash(key, _quoted(kind), turn, "i", other)

    def move(first: int, size: int) -> str:
        return f"char({first} + pmod(ascii(c) - {first} + {k}, {size}))"

    small, large = (6, 6) if kind == "hex" else (26, 26)
    classes = f"case when c between '0' and '9' then {move(48, 10)} when c between 'a' and 'z' then {move(97, small)} when c between 'A' and 'Z' then {move(65, large)} else c end"
    each = f"transform(transform(sequence(1, length({text})), p -> substring({text}, p, 1)), (c, i) -> {classes})"
    return f"if(length({text}) = 0, '', array_join({each}, ''))"


def permuted_text(key: str, kind: str, text: str) -> str:
    """SQL for ``text`` permuted among the texts with the same classes of characters at the same places."""
    half = f"cast(length({text}) div 2 as int)"
    begin = f"named_struct('l', substring({text}, 1, {half}), 'r', substring({text}, {half} + 1))"
    left = f"named_struct('l', {_shift(key, kind, 'h.l', 't', 'h.r')}, 'r', h.r)"
    right = f"named_struct('l', h.l, 'r', {_shift(key, kind, 'h.r', 't', 'h.l')})"
    return f"aggregate(sequence(1, {ROUNDS}), {begin}, (h, t) -> if(t % 2 = 1, {left}, {right}), h -> concat(h.l, h.r))"


def permuted_number(key: str, kind: str, left: str, right: str, a: str, b: str, finish: str) -> str:
    """SQL for the pair (left below a, right below b) permuted among all such pairs; ``finish`` makes a value of h.l and h.r."""
    one = f"named_struct('l', pmod(h.l + {_hash(key, _quoted(kind), 't', 'h.r')}, {a}), 'r', h.r)"
    two = f"named_struct('l', h.l, 'r', pmod(h.r + {_hash(key, _quoted(kind), 't', 'h.l')}, {b}))"
    begin = f"named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint))"
    return f"aggregate(sequence(1, {ROUNDS}), {begin}, (h, t) -> if(t % 2 = 1, {one}, {two}), h -> {finish})"


def luhn_sum(digits: str, double_last: bool) -> str:
    """SQL for the Luhn sum; ``double_last``: the last digit is one that counts double."""
    odd = 0 if double_last else 1
    d = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + if(i % 2 = {odd}, if(2 * {d} > 9, 2 * {d} - 9, 2 * {d}), {d}))"


def _laid_out(form: str, digits: str) -> str:
    """SQL for ``form`` with its digits replaced, in order, by those of ``digits``."""
    nth = f"length(regexp_replace(substring({form}, 1, p), '[^0-9]', ''))"
    each = f"transform(sequence(1, length({form})), p -> if(substring({form}, p, 1) between '0' and '9', substring({digits}, {nth}, 1), substring({form}, p, 1)))"
    return f"array_join({each}, '')"


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def mod97(text: str) -> str:
    """SQL for an IBAN's text, its first four characters moved to the end, read as a number modulo 97."""
    moved = f"concat(substring({text}, 5), substring({text}, 1, 4))"
    digit = "if(c between '0' and '9', s * 10 + ascii(c) - 48, s * 100 + ascii(c) - 55)"
    return f"aggregate(transform(sequence(1, length({text})), p -> substring({moved}, p, 1)), 0, (s, c) -> ({digit}) % 97)"


def _octets(key: str) -> str:
    """An address keeps the numbers of digits of its octets: 0-9, 10-99 or 100-255."""
    def least(i: int) -> str:
        return f"(case length(o[{i}]) when 1 then 0 when 2 then 10 else 100 end)"

    def size(i: int) -> str:
        return f"(case length(o[{i}]) when 1 then 10 when 2 then 90 else 156 end)"

    def index(i: int) -> str:
        return f"(cast(o[{i}] as int) - {least(i)})"

    valid = " and ".join(f"{index(i)} between 0 and {size(i)} - 1" for i in range(4))
    back = f"concat_ws('.', h.l div {size(1)} + {least(0)}, h.l % {size(1)} + {least(1)}, h.r div {size(3)} + {least(2)}, h.r % {size(3)} + {least(3)})"
    pair = permuted_number(
        key, "ip", f"{index(0)} * {size(1)} + {index(1)}", f"{index(2)} * {size(3)} + {index(3)}", f"({size(0)} * {size(1)})", f"({size(2)} * {size(3)})", back
    )
    return _let(r"split(m, '\\.')", "o", f"if({valid}, {pair}, m)")


def _date(key: str, parts: str, form: str) -> str:
    """``parts``: SQL for the date as year-month-day; ``form``: SQL that writes the new date ``n`` the old way."""
    days = f"datediff(v, {FIRST_DAY})"
    new = permuted_number(key, "date", f"{days} div {DAYS[1]}", f"{days} % {DAYS[1]}", str(DAYS[0]), str(DAYS[1]), f"date_add({FIRST_DAY}, cast(h.l * {DAYS[1]} + h.r as int))")
    inside = f"v is not null and {days} between 0 and {DAYS[0] * DAYS[1] - 1}"
    return _let(f"try_to_timestamp({parts}, 'yyyy-MM-dd')", "w", _let("cast(w as date)", "v", f"if({inside}, {_let(new, 'n', form)}, m)"))


def pseudonym(key: str) -> str:
    """SQL for the pseudonym of a match ``m``, which is ``m`` itself if it is not valid."""
    local = "substring_index(m, '@', 1)"
    whole = "substring_index(m, '@', -1)"
    first = f"substring_index({whole}, '.', 1)"
    email = f"concat({permuted_text(key, 'email', local)}, '@', {permuted_text(key, 'domain', first)}, substring({whole}, length({first}) + 1))"
    value = "substring_index(substring_index(m, '\"', 2), '\"', -1)"
    secret = f"concat(substring_index(m, '\"', 1), '\"', if({value} rlike '^[0-9a-f]+$' or {value} rlike '^[0-9A-F]+$', {permuted_text(key, 'hex', value)}, {permuted_text(key, 'secret', value)}), '\"')"
    rest = permuted_text(key, "iban", "substring(m, 5)")
    checked = _let(f"concat(substring(m, 1, 2), '00', {rest})", "z", f"concat(substring(z, 1, 2), lpad(cast(98 - {mod97('z')} as string), 2, '0'), substring(z, 5))")
    iban = f"if({mod97('m')} = 1, {checked}, m)"
    d = "regexp_replace(m, '[^0-9]', '')"
    ssn = f"if(m rlike '^(000|666|9)|-00-|-0000$', m, {_laid_out('m', '(' + permuted_text(key, 'ssn', d) + ')')})"
    area = "if(m like '+1%', concat('1', x), x)"
    phone = _let(f"if(m like '+1%', substring({d}, 2), {d})", "y", _let(permuted_text(key, "phone", "y"), "x", _let(area, "q", _laid_out("m", "q"))))
    body = permuted_text(key, "card", "substring(d, 1, length(d) - 1)")
    new_card = _let(body, "b", _let(f"concat(b, pmod(10 - {luhn_sum('b', True)} % 10, 10))", "e", _laid_out("m", "e")))
    card = _let(d, "d", f"if({luhn_sum('d', False)} % 10 = 0 and d rlike '[1-9]', {new_card}, m)")
    ymd = _date(key, "concat_ws('-', substring(m, 1, 4), substring(m, 6, 2), substring(m, 9, 2))", "concat(date_format(n, 'yyyy'), substring(m, 5, 1), date_format(n, 'MM'), substring(m, 8, 1), date_format(n, 'dd'))")
    dmy = _date(key, "concat_ws('-', substring(m, 7, 4), substring(m, 4, 2), substring(m, 1, 2))", "concat(date_format(n, 'dd'), substring(m, 3, 1), date_format(n, 'MM'), substring(m, 6, 1), date_format(n, 'yyyy'))")
    digits = "[0-9]"
    return (
        f"case when m like '%@%' and m not like '%\"%' then {email} when m like '%\"' then {secret} when m rlike '^[A-Z]' then {iban} "
        f"when m rlike '^{digits}{{3}}-{digits}{{2}}-{digits}{{4}}$' then {ssn} "
        f"when m rlike '^{digits}{{4}}[-/.]{digits}{{2}}[-/.]{digits}{{2}}$' then {ymd} when m rlike '^{digits}{{2}}[./]{digits}{{2}}[./]{digits}{{4}}$' then {dmy} "
        f"when m like '%.%.%.%' then {_octets(key)} when m rlike '^[+(]|^{digits}{{3}}-{digits}{{3}}-' then {phone} else {card} end"
    )


def pseudonymize(docs: DataFrame, key: str, text: str = "text", changed: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``changed`` names a column for the number of values replaced."""
    t = f"`{text}`"
    found, fresh = fresh_name(docs.columns, "__found"), fresh_name(docs.columns, "__fresh")
    may = f"{t} rlike '[0-9@=]'"
    out = docs.withColumn(found, F.expr(f"if({may}, regexp_extract_all({t}, {_quoted(ANY)}, 0), array())"))
    out = out.withColumn(fresh, F.expr(f"transform(`{found}`, m -> {pseudonym(key)})"))
    gaps = f"split({t}, {_quoted(ANY)}, -1)"
    joined = f"if(size(`{fresh}`) > 0, array_join(flatten(zip_with({gaps}, `{fresh}`, (g, f) -> array(g, coalesce(f, '')))), ''), {t})"
    columns = [F.expr(joined).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if changed:
        differ = f"size(filter(zip_with(`{found}`, `{fresh}`, (a, b) -> a <> b), x -> x))"
        columns.append(F.expr(f"cast(if(size(`{fresh}`) > 0, {differ}, 0) as int)").alias(changed))
    return out.select(*columns)
