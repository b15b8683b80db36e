"""Personal data and secrets: detection and surrogates that keep type, shape and coreference.

Every detected value is replaced by one that a keyed hash derives from it: the same value gets the same
surrogate everywhere, with the same script, letter case and format (a card number stays a valid card
number, an address a valid address, a name a name of the same gender and script). A name is a family name and
given names: a family name has one surrogate wherever it stands, so "Mr Smith" and "John Smith" stay one
family; with Dr and Prof, the given name tells the gender. Digits are a card number only if their check digit
holds. Names without a title aren't looked for. A collision check over
the distinct values of the corpus gives values whose surrogate is taken, or is a value that occurs, a new
one, until all are distinct. Surrogates of later attempts are longer, so that there are enough for any
number of values of one shape. Everything is DataFrame expressions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, discard

#: Collided values up to this number travel as a constant map; more of them are joined by shuffle.
INLINE_RETRIES = 1000

#: A surrogate gets one more syllable, letter or digit for every so many attempts.
ATTEMPTS_PER_STEP = 2

TITLES_F = "Mrs|Ms|Miss|Madam|Madame|Mme|Frau|Señora|Señorita|Sra|госпожа|Госпожа"
TITLES_M = "Mr|Sir|Monsieur|Herr|Señor|Sr|господин|Господин"
#: Words in lower case that are part of a family name.
PARTICLES = "von|vom|van|zu|zum|zur|de|del|della|di|da|das|dos|du|der|den|ter|ten|la|le|bin|ibn|al"
#: A word of a name: McDonald, O'Brien, Müller-Lüdenscheidt; a final 's isn't part of it.
_WORD = r"(?=[\p{L}\p{M}'’‐‑-]*\p{Ll})\p{Lu}[\p{L}\p{M}]*+(?:['’](?!s(?![\p{L}\p{M}]))[\p{L}\p{M}]++|[‐‑-][\p{L}\p{M}]++)*+"
_PART = rf"(?:(?:(?:{PARTICLES})[ ]|\p{{Lu}}\.[ ]?)*+){_WORD}"
_NAME = rf"[ ]{_PART}(?:[ ]{_PART})*+"

#: A secret runs to a blank, quote, bracket or separator; a dot and the like end it unless more follows.
_SECRET = r"A-Za-z0-9+/_=~@#$%^*-"

#: A host: labels up to one of letters. Possessive, so that Java walks any number of labels without recursion; where
#: what follows the last dot is no such label, as in a.com.2, of a host name's 127 labels at most the last that is one.
_LABEL, _TOP = "[A-Za-z0-9-]{1,63}", r"[A-Za-z]{2,24}(?![\w-])"
_HOST = rf"(?:{_LABEL}\.(?=[A-Za-z0-9-]))++{_TOP}|{_LABEL}(?:\.{_LABEL}){{0,126}}\.{_TOP}"

#: Given names by gender and script.
GIVEN = {
    ("f", "latin"): "Alice Anna Carla Clara Diana Elena Emma Eva Flora Grace Helen Ida Jane Julia Laura Lena Lucy Maria Mia Nina Nora Olga Paula Rosa Sara Sofia Tina Vera".split(),
    ("m", "latin"): "Adam Alan Anton Boris Carl David Eric Felix Frank Georg Hugo Ivan Jack James Karl Leon Lucas Marc Max Noah Oscar Paul Peter Robert Simon Thomas Victor Walter".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга София Тамара".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Денис Иван Кирилл Лев Максим Олег Павел Роман Юрий".split(),
}
#: Syllables of surrogate family names.
SYLLABLES = {"latin": "ba ber co dan el far gor hen il jor kel lan mor nor os per quin ros sten tor ul van wes zel".split(), "cyrillic": "ба вер гор дан ел зим ир кол лан мор нов ос пет рос сен тор ул хор".split()}

#: A given name that reads as a woman's, where the title doesn't tell.
_HERS = "(?:" + "|".join([*GIVEN["f", "latin"], *GIVEN["f", "cyrillic"]]) + r")(?![\p{L}\p{M}])|\p{Lu}[\p{L}\p{M}]+[aая](?![\p{L}\p{M}])"

#: kind, pattern. Earlier kinds win where two start at one place.
KINDS: list[tuple[str, str]] = [
    ("email", rf"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:{_HOST})"),
    ("secret", r"(?<!\w)(?i:password|passwd|pwd|secret|token|api_key|apikey|access_key)\s?[=:]\s?[\"']?" + f"(?=[+/_~@#$%^*-]*[A-Za-z0-9])(?=[^=](?:[{_SECRET}]|[.:!?](?=[{_SECRET}])){{7}})[{_SECRET}]++(?:[.:!?]++[{_SECRET}]++)*+"),
    ("access_key", r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)"),
    ("card", r"(?<![\w.])[3-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w])|(?<![\w.])3\d{3}(?:[ ]\d{6}[ ]|-\d{6}-|\d{6})\d{5}(?!\w)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\w)|(?<!\w)\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.+-])(?:1[ .-])?\d{3}(?:-\d{3}-|\.\d{3}\.|[ ]\d{3}[ ])\d{4}(?![\w-])"),
    ("name_f", rf"(?<!\w)(?:(?:{TITLES_F})\.?|(?:Dr|Prof)\.?(?=[ ](?:{_HERS})[ ]{_PART})){_NAME}"),
    ("name_m", rf"(?<!\w)(?:{TITLES_M}|Dr|Prof)\.?{_NAME}"),
]
PATTERN = "|".join(f"(?:{p})".replace(r"\1", r"\1") for _, p in KINDS)


def kind_of(value: Column) -> Column:
    """The kind of a match; its characters tell. Null for digits in the shape of a card number that are none."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS):
        found = F.lit(kind)
        if kind == "card":
            digits = F.regexp_replace(value, "[^0-9]", "")
            found = F.when(F.call_function("luhn_check", digits), F.lit(kind))
        out = F.when(value.rlike("^(?:" + pattern + ")$"), found).otherwise(out)
    return out


def canonical(kind: Column, value: Column) -> Column:
    """What makes two spellings one value: e-mail addresses ignore case, numbers their separators."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "secret", F.regexp_extract(value, r"[=:]\s?[\"']?(.*)$", 1))
        .when(kind.isin("name_f", "name_m"), F.regexp_extract(value, r"(?U)^\w+\.? (.*)$", 1))
        .otherwise(value)
    )


def _reshape(value: str, seed: str) -> str:
    """SQL: value with each ASCII letter or digit replaced by one of the same class taken from the hex
    digits of seed; hex strings stay hex."""
    return f"""transform(array({value} rlike '^[0-9a-f]+$'), hex -> array_join(transform(split({value}, ''), (c, i) -> case
      when c rlike '^[0-9]$' then translate(substr({seed}, i % 128 + 1, 1), 'abcdef', '036925')
      when hex then translate(substr({seed}, i % 128 + 1, 1), '0123456789', 'abcdefabcd')
      when c rlike '^[a-z]$' then translate(substr({seed}, i % 128 + 1, 1), '0123456789abcdef', 'acdefghklmnoprst')
      when c rlike '^[A-Z]$' then translate(substr({seed}, i % 128 + 1, 1), '0123456789abcdef', 'ACDEFGHKLMNOPRST')
      else c end), ''))[0]"""


def _number(seed: str, at: int, below: int) -> str:
    return f"pmod(cast(conv(substr({seed}, {at}, 7), 16, 10) as bigint), {below})"


def _pick(values: list[str], seed: str, at: int) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), cast({_number(seed, at, len(values))} as int) + 1)"


def _longer(values: list[str]) -> str:
    """SQL: a member of values for each hex digit of v.more."""
    listed = ", ".join(f"'{v}'" for v in values)
    return f"array_join(transform(filter(split(v.more, ''), c -> c <> ''), c -> element_at(array({listed}), cast(conv(c, 16, 10) as int) % {len(values)} + 1)), '')"


def surrogate_sql(kind: str, canon: str, key: str, attempt: str) -> str:
    """SQL of the canonical surrogate of a value: kind, canon, key and attempt are SQL expressions. Of names,
    kinds are family (canon: the family name) and given_f or given_m (canon: the whole name)."""
    seed_of = f"concat(sha2(concat_ws('|', {key}, {kind}, {canon}, {attempt}), 256), sha2(concat_ws('|', {attempt}, {key}, {kind}, {canon}), 256))"
    steps = f"least(floor(({attempt}) / {ATTEMPTS_PER_STEP}), 64)"
    more_of = f"if(({attempt}) < {ATTEMPTS_PER_STEP}, '', substr(sha2(concat_ws('|', 'more', {attempt}, {key}, {kind}, {canon}), 256), 1, cast({steps} as int)))"
    digits, letters = "translate(v.more, 'abcdef', '036925')", "translate(v.more, '0123456789abcdef', 'acdefghklmnoprst')"
    shaped = _reshape("v.canon", "v.seed")
    # a digit string whose last digit makes the Luhn sum a multiple of ten
    head = "if(length(v.canon) = 15, 2, 1)"
    body = f"concat(substr(v.canon, 1, {head}), substr({shaped}, {head} + 1, length(v.canon) - 1 - {head}), {digits})"
    luhn = "aggregate(transform(split(reverse(b), ''), (c, i) -> if(i % 2 = 0, cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0), cast(c as int))), 0, (t, x) -> t + x)"
    card = f"transform(array({body}), b -> concat(b, cast(pmod(10 - {luhn} % 10, 10) as string)))[0]"
    # IPv4 has no longer addresses: later attempts are IPv6 addresses of the range for documentation
    ip6 = "concat_ws(':', '2001:db8', " + ", ".join(f"substr(v.seed, {at}, 4)" for at in range(1, 25, 4)) + ")"
    ip = f"concat_ws('.', {_number('v.seed', 1, 126)} + 1, {_number('v.seed', 9, 256)}, {_number('v.seed', 17, 256)}, {_number('v.seed', 25, 254)} + 1)"
    ip = f"if(v.more = '', {ip}, {ip6})"
    # country code and length stay; the first digit after the code is not 0
    phone = f"concat(substr(v.canon, 1, length(v.canon) - 10), cast({_number('v.seed', 41, 8)} + 2 as string), right({shaped}, least(length(v.canon), 10) - 1), {digits})"
    def by_script(make) -> str:
        return rf"if(v.canon rlike '\\p{{IsCyrillic}}', {make('cyrillic')}, {make('latin')})"

    def syllables(script: str) -> str:
        return f"initcap(concat({_pick(SYLLABLES[script], 'v.seed', 11)}, {_pick(SYLLABLES[script], 'v.seed', 21)}, {_pick(SYLLABLES[script], 'v.seed', 31)}, {_longer(SYLLABLES[script])}))"

    family = by_script(syllables)
    first_f, first_m = (by_script(lambda script, g=g: f"concat({_pick(GIVEN[g, script], 'v.seed', 1)}, {_longer(SYLLABLES[script])})") for g in "fm")
    email = f"concat({_reshape('x.local', 'v.seed')}, {letters}, '@', {_reshape('x.host', 'reverse(v.seed)')}, x.top)"
    email = rf"transform(array(named_struct('local', regexp_extract(v.canon, '^(.*)@', 1), 'host', regexp_extract(v.canon, '@(.*)\\.[a-z]+$', 1), 'top', regexp_extract(v.canon, '(\\.[a-z]+)$', 1))), x -> {email})[0]"
    access = f"concat(substr(v.canon, 1, 4), {_reshape('substr(v.canon, 5)', 'v.seed')}, upper({letters}))"
    return f"""transform(array(named_struct('kind', {kind}, 'canon', {canon}, 'seed', {seed_of}, 'more', {more_of})), v -> case v.kind
      when 'email' then {email} when 'card' then {card} when 'ip' then {ip} when 'phone' then {phone}
      when 'access_key' then {access} when 'given_f' then {first_f} when 'given_m' then {first_m}
      when 'family' then {family} when 'name_f' then {family} when 'name_m' then {family}
      when 'ssn' then concat({shaped}, {digits}) else concat({shaped}, if(v.canon rlike '^[0-9]+$', {digits}, v.more)) end)[0]"""


def spell_sql(kind: str, value: str, canon: str, sub: str) -> str:
    """SQL: the canonical surrogate sub in the format of the value it replaces."""
    digits = f"""aggregate(split({value}, ''), named_struct('out', '', 'i', 1), (acc, c) ->
      if(c rlike '^[0-9]$', named_struct('out', concat(acc.out, substr({sub}, acc.i, 1)), 'i', acc.i + 1), named_struct('out', concat(acc.out, c), 'i', acc.i)), acc -> concat(acc.out, substr({sub}, acc.i)))"""
    return f"""case when {kind} in ('phone', 'card', 'ssn') then {digits}
      when {kind} in ('secret', 'name_f', 'name_m') then concat(substr({value}, 1, length({value}) - length({canon})), {sub})
      when {kind} = 'email' and {value} = upper({value}) then upper({sub}) else {sub} end"""


def parts_of(kind: Column, canon: Column) -> Column:
    """array<struct<kind, canon>>: what gets a surrogate of its own; of a name, the family name and, if there is
    one, what is given: the whole name, since given names are told apart within a family."""
    part = lambda k, c: F.struct(k.cast("string").alias("kind"), c.alias("canon"))
    given = F.when(canon.rlike(r"^\p{Lu}.* "), F.array(part(F.replace(kind, F.lit("name"), F.lit("given")), canon)))
    names = F.concat(F.array(part(F.lit("family"), F.regexp_extract(canon, r"([^ ]*)$", 1))), F.coalesce(given, F.array().cast("array<struct<kind:string,canon:string>>")))
    return F.when(kind.isin("name_f", "name_m"), names).otherwise(F.array(part(kind, canon)))


def retries(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt of the values whose first surrogate was taken. entities: distinct kind, canon.

    A surrogate is taken if another value has it, or if it occurs as a value; given names are taken within
    their family only. The value that comes first keeps it; the others try again, until no surrogate is shared."""
    from pyspark.sql import Window as W

    known = cut(entities.select("kind", "canon").distinct())
    is_given = F.col("kind").isin("given_f", "given_m")
    within = F.when(is_given, F.regexp_extract("canon", r"([^ ]*)$", 1)).otherwise("")
    scope = F.when(is_given, F.lit("given")).otherwise(F.col("kind"))
    state = known.withColumn("attempt", F.lit(0))
    while True:
        scored = cut(state.withColumn("sub", F.expr(surrogate_sql("kind", "canon", f"'{key}'", "attempt"))).withColumns({"scope": scope, "within": within}))
        place = F.row_number().over(W.partitionBy("scope", "within", "sub").orderBy("attempt", "canon", "kind"))
        real = known.where(~is_given).select("kind", F.col("canon").alias("sub"), F.lit(True).alias("real"))
        checked = scored.join(real.hint("merge"), ["kind", "sub"], "left").withColumn("place", place)
        bad = (F.col("place") > 1) | F.coalesce("real", F.lit(False))
        after = cut(checked.select("kind", "canon", F.col("attempt") + bad.cast("int"), bad.alias("bad")).toDF("kind", "canon", "attempt", "bad"))
        discard(scored)
        state = after.drop("bad")
        if after.where("bad").isEmpty():
            return state.where("attempt > 0")


def replace_pii(docs: DataFrame, key: str = "surrogate-key", columns: list[str] | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text, n_entities, kinds and columns (names of
    docs' own to carry along). text has every detected value replaced; kinds lists their kinds, sorted,
    comma-joined. A null text stays null, with n_entities 0; clean and empty texts stay as they are;
    rows that repeat get equal results; an empty table gives an empty result. Local parts, hosts and secrets of any
    length are replaced whole. Private key blocks, bearer headers, IBAN and IPv6 aren't looked for."""
    carried = [F.col(f"`{c}`") for c in columns or []]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    found = F.when(F.col("text").rlike(r"[@+=:(]|\d[\d. -]{5}|AKIA|ASIA|(?:" + f"{TITLES_F}|{TITLES_M}|Dr|Prof" + rf")\.? (?:\p{{Lu}}|(?:{PARTICLES}) )"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    base = base.withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
    kind = kind_of(F.col("value"))
    values = base.where(F.size("found") > 0).select(F.explode("found").alias("value")).distinct().withColumn("kind", kind).where("kind is not null")
    parts = values.select(F.explode(parts_of(F.col("kind"), canonical(F.col("kind"), F.col("value")))).alias("p")).select("p.kind", "p.canon")
    again = cut(retries(parts, key))

    n = again.count()
    if n <= INLINE_RETRIES:
        pairs = {f"{r['kind']}|{r['canon']}": r["attempt"] for r in again.collect()}
        base = base.withColumn("retry", F.from_json(F.lit(json.dumps(pairs)), "map<string,int>"))
    else:
        of = base.where(F.size("found") > 0).select("doc_id", F.xxhash64("text").alias("_hash"), F.explode("found").alias("value")).withColumn("kind", kind)
        of = of.where("kind is not null").withColumn("p", F.explode(parts_of(F.col("kind"), canonical(F.col("kind"), F.col("value"))))).select("doc_id", "_hash", "p.kind", "p.canon").join(again.hint("merge"), ["kind", "canon"])
        maps = of.groupBy("doc_id", "_hash").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("retry"))
        maps = maps.withColumnsRenamed({"doc_id": "_id", "_hash": "_of"})
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_of"))
        base = base.join(maps.hint("merge"), same, "left").drop("_id", "_of")

    shaped = F.transform("found", lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    shaped = F.transform(shaped, lambda x: F.struct(x["value"].alias("value"), x["kind"].alias("kind"), canonical(x["kind"], x["value"]).alias("canon")))
    hits = base.withColumn("hits", F.when(F.size("found") > 0, shaped))
    new = lambda kind, canon: surrogate_sql(kind, canon, f"'{key}'", f"coalesce(retry[concat_ws('|', {kind}, {canon})], 0)")
    named = "h.kind in ('name_f', 'name_m')"
    family, given = new("'family'", "regexp_extract(h.canon, '([^ ]*)$', 1)"), new("replace(h.kind, 'name', 'given')", "h.canon")
    name = rf"if(h.canon rlike '^\\p{{Lu}}.* ', concat({given}, ' ', {family}), {family})"
    sub = f"if({named}, {name}, {new('h.kind', 'h.canon')})"
    spelled = f"transform(hits, h -> if(h.kind is null, h.value, transform(array({sub}), s -> {spell_sql('h.kind', 'h.value', 'h.canon', 's')})[0]))"
    hits = hits.withColumn("subs", F.expr(spelled)).withColumn("gaps", F.when(F.size("found") > 0, F.split("text", PATTERN, -1)))
    merged = F.array_join(F.flatten(F.zip_with("gaps", F.concat("subs", F.array(F.lit(""))), lambda g, s: F.array(g, s))), "")
    known = F.filter(F.coalesce(F.col("hits.kind"), F.array().cast("array<string>")), lambda k: k.isNotNull())
    kinds = F.array_join(F.array_sort(F.array_distinct(known)), ",")
    return hits.select("doc_id", F.coalesce(merged, F.col("text")).alias("text"), F.size(known).cast("long").alias("n_entities"), kinds.alias("kinds"), *carried)
