"""Surrogates for personal data, by SQL expressions only.

Detected entities are replaced by keyed surrogates of the same type and format. Numbers (phones, cards, national
numbers, IPv4) go through a keyed Feistel permutation of their digits; mail addresses, IPv6 addresses, bank
accounts, keys and secrets through one of their characters that keeps each character's class; so different entities
of a format get different surrogates, and cards and accounts valid check digits. Names are spelled from a keyed hash, with
the gender and script of the name kept. A surrogate depends on the key and the entity alone, so the same entity gets the
same one in every document (coreference). That no two entities of a type share a surrogate is checked over the whole corpus,
and that none is itself an entity of it; where that fails, the entities concerned get another, by a variation of the key for them
alone. In a number range so crowded that FRESH_TURNS variations all meet real numbers, a surrogate may be one: it still is
nobody else's surrogate, and the real one is replaced as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm._sql import let, lets, quoted
from wattline.llm._support import forget, keep

#: Titles by gender (n: either) and language, and given names by gender and script: fixed values.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr"], "n": ["Dr", "Prof", "Professor"]}
GIVEN = {
    ("f", "latin"): ["Alice", "Clara", "Emma", "Hannah", "Julia", "Laura", "Maria", "Olivia", "Sophia", "Victoria"],
    ("m", "latin"): ["Adam", "Benjamin", "David", "George", "Jakob", "Lukas", "Michael", "Oscar", "Robert", "William"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Мария", "Наталья", "Ольга", "Татьяна"],
    ("m", "cyrillic"): ["Алексей", "Борис", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей"],
    ("f", "greek"): ["Αλεξάνδρα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία"],
    ("m", "greek"): ["Αλέξανδρος", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος"],
}
#: Syllables for invented family names by script: sixteen first letters and four second ones.
LETTERS = {"latin": ("bdfgklmnprstvwzj", "aeio"), "cyrillic": ("бвгджзклмнпрстфх", "аеио"), "greek": ("βγδζθκλμνπρστφχψ", "αειο")}
SYLLABLES = {script: [a + b for a in first for b in second] for script, (first, second) in LETTERS.items()}
#: Syllables of an invented family name: 48 bits, so that a hundred million names share about ten surrogates.
NAME_SYLLABLES = 8
#: Letters and digits that stand for each other, beside the hexadecimal ones; other characters stay as they are.
CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "àáâäåæçèéêëìíîïñòóôöøùúûüýßœ", "ÀÁÂÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖØÙÚÛÜÝŒ"]
# Groups that repeat are possessive: Java's matcher recurses for each turn of the others and ends in a stack overflow.
WORD = r"\p{Lu}[\p{L}'’-]++"
LABEL = r"[\p{L}\p{N}-]"
EMAIL = rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++@(?:{LABEL}++\.(?={LABEL}*\p{{L}}|[\p{{N}}-]+\.{LABEL}))++\p{{L}}{{2,}}"
NAMED_SECRET = r"(?i:\b(?:token|secret|passwd|password|api[_-]?key|access[_-]?key)\s*[=:]\s*)"
SECRET = NAMED_SECRET + r"(?:[\"'][^\"'\s]{8,}[\"']|(?=[A-Za-z_./+~-]*\d)(?=[\d_./+~-]*[A-Za-z])[A-Za-z0-9_./+~-]{11,}[A-Za-z0-9_/+~-])"
CLOUD_START = r"(?:AKIA|ASIA|AIza|gh[pousr]_|xox[abprs]-)"
CLOUD = r"(?<![\p{L}\p{N}_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{35}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![\p{L}\p{N}_-])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![\p{L}\p{N}])"
HEX = "[0-9A-Fa-f]"
IPV6 = rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{HEX}{{1,4}}:){{7}}{HEX}{{1,4}}|(?:{HEX}{{1,4}}:){{2,6}}(?::{HEX}{{1,4}}){{1,5}}|{HEX}{{4}}:(?::{HEX}{{1,4}}){{1,6}})(?![\p{{L}}\p{{N}}:])"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
NATIONAL = r"(?<![\p{L}\d-])(?!000|666)[0-8]\d{2}-(?!00)\d{2}-(?!0000)\d{4}(?![\p{L}\d-])"
CARD = r"(?<![\p{L}\d])(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{13,18})(?![\p{L}\d])"
PHONE = r"(?<![\p{L}\d])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)|(?<![\p{L}\d])\+\d{1,3}[ .-]?\(?\d{1,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\p{L}\d])\+\d{1,3}[ .-]?\(?\d{1,3}\)?(?:[ .-]\d{2,3}){3,4}(?!\d)|(?<![\p{L}\d])(?:\(\d{3}\) \d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d(?:[ .-]\d{2}){4})(?![.-]?\d)"
TITLED = r"\b(?:" + "|".join(t for x in TITLES.values() for t in x) + rf")\.? {WORD}(?: {WORD})*+"
NAMED = r"(?<![\p{L}])(?:" + "|".join(n for x in GIVEN.values() for n in x) + rf") {WORD}"
KINDS = {"email": EMAIL, "secret": SECRET, "cloud": CLOUD, "iban": IBAN, "ipv6": IPV6, "ipv4": IPV4, "national": NATIONAL, "card": CARD, "phone": PHONE, "titled": TITLED, "named": NAMED}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
QUOTES = "\"'"
#: Written before and after each match, so that one pass both finds and cuts.
MARK = "\x01"
#: Exceptions that are broadcast as one map, in which a look-up is a linear search; more are joined by text.
MOST_OWN = 1000
#: Parts into which the texts of equal content are dealt for that join.
SALTS = 8
#: Turns in which a surrogate must also differ from all real entities; a crowded number range may have no other left.
FRESH_TURNS = 4


def _hash(key: str, entity: str) -> str:
    return f"sha2(concat({quoted(key)}, '|', {entity}), 256)"


def feistel(rounds: int, a: str, b: str, mixed_a: str, mixed_b: str) -> str:
    """SQL for `rounds` rounds over the halves of a struct ab(a, b): odd ones mix b into a, even ones a into b, r being the round."""
    return f"aggregate(sequence(1, {rounds}), struct({a} AS a, {b} AS b), (ab, r) -> IF(r % 2 = 1, struct({mixed_a} AS a, ab.b AS b), struct(ab.a AS a, {mixed_b} AS b)))"


def permuted(digits: str, key: str) -> str:
    """SQL for a keyed permutation of the strings of as many digits (at most 18): six Feistel rounds."""
    mixed = lambda half, other, size: f"pmod(ab.{half} + pmod(xxhash64({quoted(key)}, r, ab.{other}), {size}), {size})"
    return lets(
        ("ds", digits), ("na", "CAST(length(ds) DIV 2 AS int)"), ("nb", "length(ds) - na"), ("pa", "CAST(power(10, na) AS long)"), ("pb", "CAST(power(10, nb) AS long)"),
        ("ab", feistel(6, "CAST(concat('0', substring(ds, 1, na)) AS long)", "CAST(concat('0', substring(ds, na + 1)) AS long)", mixed("a", "b", "pa"), mixed("b", "a", "pb"))),
        then="concat(lpad(CAST(ab.a AS string), na, '0'), lpad(CAST(ab.b AS string), nb, '0'))",
    )


def ciphered(text: str, key: str) -> str:
    """SQL for a keyed permutation of the strings of a shape: eight Feistel rounds over the two halves, in each of which a
    character moves within its class. A string of hexadecimal digits with letters stays hexadecimal."""
    classes = " ".join(f"WHEN instr({quoted(c)}, c) > 0 THEN {quoted(c)}" for c in CLASSES)
    kind = f"CASE WHEN lower_hex AND instr('0123456789abcdef', c) > 0 THEN '0123456789abcdef' WHEN upper_hex AND instr('0123456789ABCDEF', c) > 0 THEN '0123456789ABCDEF' {classes} ELSE c END"
    mixed = lambda half, other, base: let("hs", f"sha2(concat({quoted(key)}, '|', r, '|', array_join(ab.{other}, ',')), 256)", f"transform(ab.{half}, (v, i) -> CAST(pmod(v + xxhash64(hs, i), length(ks[i + {base}])) AS int))")
    return lets(
        ("whole", text), ("lower_hex", "whole RLIKE '^[0-9a-f:]*[a-f][0-9a-f:]*$'"), ("upper_hex", "whole RLIKE '^[0-9A-F:]*[A-F][0-9A-F:]*$'"),
        ("cs", "filter(split(whole, ''), c -> c != '')"), ("ks", f"transform(cs, c -> {kind})"), ("m", "CAST(size(cs) DIV 2 AS int)"),
        ("vs", "transform(cs, (c, i) -> instr(ks[i], c) - 1)"), ("ab", feistel(8, "slice(vs, 1, m)", "slice(vs, m + 1, size(vs) - m)", mixed("a", "b", "0"), mixed("b", "a", "m"))),
        then="array_join(transform(concat(ab.a, ab.b), (v, i) -> substring(ks[i], v + 1, 1)), '')",
    )


def mod97(account: str) -> str:
    """SQL for an account's remainder (1: valid), its first four characters moved to the end."""
    moved = "concat(substring(acc, 5), substring(acc, 1, 4))"
    return let("acc", f"replace({account}, ' ', '')", f"aggregate(filter(split({moved}, ''), c -> c != ''), 0, (r, c) -> IF(c RLIKE '[0-9]', (r * 10 + CAST(c AS int)) % 97, (r * 100 + ascii(c) - 55) % 97))")


def luhn(digits: str) -> str:
    """SQL for the check sum of a digit string (0: valid)."""
    return f"aggregate(split(reverse({digits}), ''), struct(0L AS i, 0L AS s), (a, c) -> IF(c = '', a, struct(a.i + 1L AS i, a.s + IF(a.i % 2 = 0, CAST(c AS int), (CAST(c AS int) * 2) % 10 + (CAST(c AS int) * 2) DIV 10) AS s)), a -> a.s % 10)"


def refilled(shape: str, digits: str) -> str:
    """SQL: the digits put in the places of `shape`'s digits."""
    return f"array_join(zip_with(split({shape}, '[0-9]', -1), split({digits}, ''), (gap, d) -> concat(coalesce(gap, ''), coalesce(d, ''))), '')"


def spelled(h: str, script: str) -> str:
    names = SYLLABLES[script]
    table = "array(" + ", ".join(map(quoted, names)) + ")"
    return f"initcap(array_join(transform(sequence(1, {NAME_SYLLABLES}), i -> element_at({table}, CAST(pmod(xxhash64({h}, i), {len(names)}) AS int) + 1)), ''))"


def _name(h: str, given: str, gender: str) -> str:
    """A family name, and a given name where there was one: of its list, else of the title's gender (by the hash if it tells none) and the word's script."""
    scripts = [("cyrillic", r"\\p{IsCyrillic}"), ("greek", r"\\p{IsGreek}")]
    family = f"CASE {' '.join(f'WHEN e RLIKE {quoted_re(c)} THEN {spelled(h, s)}' for s, c in scripts)} ELSE {spelled(h, 'latin')} END"
    tables = {k: "array(" + ", ".join(map(quoted, names)) + ")" for k, names in GIVEN.items()}
    one = {k: f"element_at({tables[k]}, CAST(pmod(xxhash64({h}), {len(names)}) AS int) + 1)" for k, names in GIVEN.items()}
    listed = " ".join(f"WHEN array_contains({tables[k]}, {given}) THEN {one[k]}" for k in GIVEN)
    woman = f"({gender} = 'f' OR ({gender} = 'n' AND xxhash64({h}, 1) % 2 = 0))"
    other = " ".join(f"WHEN {given} RLIKE {quoted_re(c)} THEN IF({woman}, {one['f', s]}, {one['m', s]})" for s, c in scripts)
    return f"concat(CASE WHEN {given} = '' THEN '' {listed} {other} ELSE IF({woman}, {one['f', 'latin']}, {one['m', 'latin']}) END, IF({given} = '', '', ' '), {family})"


#: Gender of a titled match, and what stands for a person: the name, with the gender where no list gives it.
GENDER = "CASE " + " ".join(f"WHEN e RLIKE '^({'|'.join(TITLES[g])})[.]? ' THEN {quoted(g)}" for g in "fm") + " ELSE 'n' END"
PERSON_K = "IF(k IN ('titled', 'named'), 'person', k)"
_REST = "substring(e, instr(e, ' ') + 1)"
PERSON_E = f"CASE k WHEN 'titled' THEN concat(IF(instr({_REST}, ' ') = 0 OR array_contains(array({', '.join(quoted(n) for x in GIVEN.values() for n in x)}), substring_index({_REST}, ' ', 1)), '', concat({GENDER}, '/')), {_REST}) ELSE e END"
#: What a reader of the text would see of an entity of assigned().
SHOWN = "IF(k = 'person', substring(e, instr(e, '/') + 1), e)"


def quoted_re(pattern: str) -> str:
    return "'" + pattern + "'"


def surrogate(key: str) -> str:
    """SQL for the surrogate of an entity `e` of kind `k`; for persons see PERSON_K and PERSON_E."""
    digits = "regexp_replace({}, '[^0-9]+', '')"
    octets = let("q", "split(e, '[.]')", "CAST(q[0] AS long) * 16777216 + CAST(q[1] AS long) * 65536 + CAST(q[2] AS long) * 256 + CAST(q[3] AS long)")
    mixed = lambda half, other: f"pmod(ab.{half} + pmod(xxhash64(concat({quoted(key)}, zeros), r, ab.{other}), 65536), 65536)"
    # A spelling with leading zeros is an entity of its own.
    zeros = "IF(e RLIKE '(^|[.])0[0-9]', e, '')"
    address = lets(("zeros", zeros), ("o", octets), ("ab", feistel(4, "o DIV 65536", "o % 65536", mixed("a", "b"), mixed("b", "a"))), then="concat_ws('.', ab.a DIV 256, ab.a % 256, ab.b DIV 256, ab.b % 256)")
    person = lets(("g", "substring_index(e, '/', 1)"), ("rest", "substring(e, instr(e, '/') + 1)"), ("given", "IF(instr(rest, ' ') > 0, substring_index(rest, ' ', 1), '')"), ("h", _hash(key, "concat('name', e)")), then=_name("h", "given", "g"))
    # What is before and after the part that moves, by kind; the two permutations are written once for all kinds, as the driver plans what is written.
    before = rf"CASE WHEN k IN ('secret', 'cloud') THEN regexp_extract(e, {_pattern(f'^(?:{NAMED_SECRET}[{QUOTES}]?|{CLOUD_START})')}, 0) WHEN k = 'phone' THEN regexp_extract(e, '^([+][0-9]{{1,3}}[ .-]|)', 1) WHEN k = 'iban' THEN substring(e, 1, 2) ELSE '' END"
    after = rf"CASE k WHEN 'email' THEN regexp_extract(e, '[.][^.]+$', 0) WHEN 'secret' THEN regexp_extract(e, {_pattern(f'[{QUOTES}]$')}, 0) WHEN 'cloud' THEN regexp_extract(e, {_pattern(f'[{QUOTES}]$')}, 0) ELSE '' END"
    letters = "CASE WHEN k IN ('email', 'secret', 'cloud', 'ipv6') THEN substring(e, length(head) + 1, length(e) - length(head) - length(tail)) WHEN k = 'iban' THEN substring(replace(e, ' ', ''), 5) ELSE '' END"
    numbers = f"CASE k WHEN 'card' THEN substring({digits.format('e')}, 2, length({digits.format('e')}) - 2) WHEN 'phone' THEN {digits.format('substring(e, length(head) + 1)')} WHEN 'national' THEN {digits.format('e')} ELSE '' END"
    account = let("acct", f"concat(head, lpad(CAST(98 - {mod97("concat(head, '00', moved)")} AS string), 2, '0'), moved)", "IF(instr(e, ' ') > 0, regexp_replace(acct, '(.{4})(?=.)', '$1 '), acct)")
    card = let("c", f"concat(substring({digits.format('e')}, 1, 1), rolled)", f"concat(c, CAST((10 - {luhn("concat(c, '0')")}) % 10 AS string))")
    filled = refilled("IF(k = 'phone', substring(e, length(head) + 1), e)", f"IF(k = 'card', {card}, rolled)")
    whole = f"CASE WHEN k = 'email' THEN concat(moved, tail, '.example') WHEN k IN ('secret', 'cloud') THEN concat(head, moved, tail) WHEN k = 'iban' THEN {account} WHEN k = 'ipv6' THEN moved WHEN k IN ('national', 'card', 'phone') THEN concat(head, {filled}) WHEN k = 'ipv4' THEN {address} WHEN k = 'person' THEN {person} ELSE e END"
    return lets(("head", before), ("tail", after), ("core", letters), ("moved", f"IF(core = '', '', {ciphered('core', key)})"), ("number", numbers), ("rolled", f"IF(number = '', '', {permuted('number', key)})"), then=whole)


def _pattern(p: str) -> str:
    return "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kind(e: str) -> str:
    """SQL for the kind of a match; cards and accounts that fail their check sums are none and stay."""
    arms = " ".join(f"WHEN {e} RLIKE {_pattern(f'^(?:{p})$')} THEN {quoted(k)}" for k, p in KINDS.items() if k not in ("card", "iban"))
    valid = luhn(f"regexp_replace({e}, '[^0-9]+', '')") + " = 0"
    return f"CASE WHEN {e} RLIKE {_pattern(f'^(?:{CARD})$')} THEN IF({valid}, 'card', 'none') WHEN {e} RLIKE {_pattern(f'^(?:{IBAN})$')} THEN IF({mod97(e)} = 1, 'iban', 'none') {arms} ELSE 'none' END"


#: A text without any of these holds no entity; most texts are done after this one look.
HINT = r"[@0-9]|[=:]\s*[\"']|(?:AKIA|ASIA)[A-Z]|(?=[A-ZА-ЯΑ-Ω])(?:" + "|".join([*(t for x in TITLES.values() for t in x), *(n for x in GIVEN.values() for n in x)]) + ")"


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct entities of a corpus: k, e. Pre-aggregated before the shuffle."""
    found = docs.selectExpr(f"`{text_col}` AS body").where(f"body RLIKE {_pattern(HINT)}").selectExpr(f"explode(regexp_extract_all(body, {_pattern(ANY)}, 0)) AS e")
    return found.groupBy("e").count().selectExpr(f"{_kind('e')} AS k", "e").where("k != 'none'")


def assigned(found: DataFrame, key: str) -> DataFrame:
    """k, e, s of the distinct entities; titled forms of a person are one."""
    return found.selectExpr(f"{PERSON_K} AS k", f"{PERSON_E} AS e").distinct().selectExpr("k", "e", f"{surrogate(key)} AS s")


def collisions(found: DataFrame, key: str) -> int:
    """How many surrogates stand for more than one entity of a kind."""
    return assigned(found, key).groupBy("k", "s").agg(F.min("e").alias("a"), F.max("e").alias("b")).where("a != b").count()


def exceptions(found: DataFrame, key: str) -> DataFrame:
    """k, e, s of the entities that can't keep their surrogate under `key`, with one of their own. Of a shared surrogate the
    entity first in order keeps it; the others, and entities whose surrogate is itself an entity, vary the key
    until none are left. Only those are worked on again: the rest is written once."""
    taken = keep(assigned(found, key).withColumn("turn", F.lit(0)), "surrogates")
    real = taken.selectExpr("k", f"{SHOWN} AS s").distinct().withColumn("real", F.lit(True))
    order = Window.partitionBy("k", "s").orderBy("turn", "e")
    own, turn = None, 0
    while True:
        # Whoever shares a surrogate with an exception is looked at again, so a new one never takes a kept one.
        now = taken if own is None else taken.join(own.select("k", "e"), ["k", "e"], "left_anti").union(own)
        judged = now.join(real, ["k", "s"], "left").withColumn("place", F.row_number().over(order))
        again = f"place > 1 OR (turn < {FRESH_TURNS} AND real)"
        judged = keep(judged.where(f"turn > 0 OR {again}").selectExpr("k", "e", "s", "turn", f"coalesce({again}, false) AS again"), "ranked")
        turn += 1
        if own is not None:
            forget(own)
        if not judged.where("again").limit(1).count():
            forget(taken)
            return judged.drop("turn", "again") if own is None else keep(judged.select("k", "e", "s"), "exceptions")
        moved = judged.where("again").selectExpr("k", "e", f"{surrogate(f'{key}/{turn}')} AS s", f"{turn} AS turn")
        own = keep(judged.where("NOT again").select("k", "e", "s", "turn").union(moved), "own")
        forget(judged)


#: The kind and the name under which a match m is looked up.
_LOOKED_UP = (("k", "kind"), ("e", "m"), ("known", f"struct({PERSON_K} AS k, {PERSON_E} AS e)"))


def _own_by_text(docs: DataFrame, own: DataFrame, text_col: str) -> DataFrame:
    """docs with the map of each text's exceptional entities (null for most). The entities of the texts meet the exceptions by
    shuffle on the entity, and texts meet their maps by shuffle on their digest; both are salted, as an entity or a text may be everywhere."""
    body, salts = F.col(f"`{text_col}`"), F.sequence(F.lit(0), F.lit(SALTS - 1))
    keyed = docs.withColumns({"_wattline_text": F.sha2(body, 256), "_wattline_salt": F.pmod(F.xxhash64(*(f"`{c}`" for c in docs.columns)), F.lit(SALTS)).cast("int")})
    seen = docs.select(F.sha2(body, 256).alias("t"), body.alias("body")).where(f"body RLIKE {_pattern(HINT)}").selectExpr("t", f"explode(array_distinct(regexp_extract_all(body, {_pattern(ANY)}, 0))) AS m")
    seen = seen.distinct().selectExpr("t", lets(("kind", _kind("m")), *_LOOKED_UP, then="known") + " AS known").selectExpr("t", "known.k", "known.e", f"CAST(pmod(xxhash64(t), {SALTS}) AS int) AS salt")
    many = own.withColumn("salt", F.explode(salts))
    maps = seen.join(many, ["k", "e", "salt"]).select("t", F.concat_ws("|", "k", "e").alias("e"), "s").distinct()
    maps = maps.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("e", "s"))).alias("_wattline_own"))  # of one text
    maps = maps.select(F.col("t").alias("_wattline_text"), "_wattline_own", F.explode(salts).alias("_wattline_salt"))
    return keyed.join(maps, ["_wattline_text", "_wattline_salt"], "left")


def replace_personal_data(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with surrogates in `text_col`; all other columns stay. `key` is the secret that surrogates depend on.
    With `count_col`, a column of that name has the number of entities replaced in the row.

    Null and empty texts stay as they are. Rows are judged alone, so repeated rows give repeated
    results, and ids play no part. Overlapping matches: the leftmost, then the first kind in KINDS. An
    empty table gives an empty result. The entities with surrogates of their own are broadcast as one map if they are at most
    MOST_OWN; more (they grow with the square of the numbers of a form) are joined by text, to the same result.
    """
    used, columns = f"{key}/0", docs.columns
    found = keep(entities(docs, text_col), "entities")
    own = exceptions(found, used)
    forget(found)
    n_own = own.count()
    shown = surrogate(used)
    if n_own:
        if n_own > MOST_OWN:
            docs = _own_by_text(docs, own, text_col)
        else:
            table = own.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "k", "e"), "s"))).alias("_wattline_own"))
            docs = docs.crossJoin(F.broadcast(table))
        shown = f"coalesce(element_at(`_wattline_own`, concat(k, '|', e)), {shown})"
    title = "IF(kind = 'titled', substring(m, 1, instr(m, ' ')), '')"
    entity = lets(("kind", _kind("m")), *_LOOKED_UP, ("k", "known.k"), ("e", "known.e"), then=f"IF(kind = 'none', struct(m AS s, 0 AS n), struct(concat({title}, {shown}) AS s, 1 AS n))")
    body, mark = f"`{text_col}`", quoted(MARK)
    # A text that holds the mark itself is cut by a second pass.
    once = f"split(regexp_replace({body}, {_pattern(ANY)}, '{MARK}$0{MARK}'), {mark}, -1)"
    twice = f"filter(flatten(zip_with(split({body}, {_pattern(ANY)}, -1), regexp_extract_all({body}, {_pattern(ANY)}, 0), (gap, m) -> array(gap, m))), x -> x IS NOT NULL)"
    filled = let("cut", f"IF(instr({body}, {mark}) > 0, {twice}, {once})", let("put", f"transform(cut, (m, i) -> IF(i % 2 = 0, struct(m AS s, 0 AS n), {entity}))", "struct(array_join(put.s, '') AS s, aggregate(put.n, 0, (a, x) -> a + x) AS n)"))
    done = docs.withColumn("_wattline_filled", F.expr(f"IF({body} RLIKE {_pattern(HINT)}, {filled}, struct({body} AS s, 0 AS n))"))
    counted = [] if count_col is None else [f"CAST(_wattline_filled.n AS long) AS `{count_col}`"]
    return done.selectExpr(*(f"_wattline_filled.s AS `{c}`" if c == text_col else f"`{c}`" for c in columns if c != count_col), *counted)
