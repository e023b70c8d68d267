"""Language and facet classification of dictionaries from what they declare, their path and their title."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ISO 639-1 code (639-3 where there is none), ISO 639-2 codes and English names, by code.
LANGUAGES = """af afr Afrikaans
am amh Amharic
ar ara Arabic
ast - Asturian
az aze Azerbaijani
ba bak Bashkir
be bel Belarusian
bg bul Bulgarian
bn ben Bengali
br bre Breton
bs bos Bosnian
ca cat Catalan,Valencian
cs cze,ces Czech
cv chv Chuvash
cy wel,cym Welsh
da dan Danish
de ger,deu German
el gre,ell Greek
en eng English
eo epo Esperanto
es spa Spanish,Castilian
et est Estonian
eu baq,eus Basque
fa per,fas Persian,Farsi
fi fin Finnish
fo fao Faroese
fr fre,fra French
fy fry Western Frisian,Frisian
ga gle Irish
gd gla Scottish Gaelic
gl glg Galician
grc - Ancient Greek
gv glv Manx
ha hau Hausa
he heb Hebrew
hi hin Hindi
hr hrv Croatian
hu hun Hungarian
hy arm,hye Armenian
id ind Indonesian
is ice,isl Icelandic
it ita Italian
ja jpn Japanese
ka geo,kat Georgian
kk kaz Kazakh
km khm Khmer
kn kan Kannada
ko kor Korean
ky kir Kyrgyz
la lat Latin
lb ltz Luxembourgish
lo lao Lao
lt lit Lithuanian
lv lav Latvian
mk mac,mkd Macedonian
ml mal Malayalam
mn mon Mongolian
ms may,msa Malay
mt mlt Maltese
my bur,mya Burmese
nb nob Norwegian Bokmal
ne nep Nepali
nl dut,nld Dutch,Flemish
nn nno Norwegian Nynorsk
no nor Norwegian
pa pan Punjabi,Panjabi
pl pol Polish
pt por Portuguese
ro rum,ron Romanian,Moldavian
ru rus Russian
sa san Sanskrit
si sin Sinhala,Sinhalese
sk slo,slk Slovak
sl slv Slovenian,Slovene
sq alb,sqi Albanian
sr srp Serbian
sv swe Swedish
sw swa Swahili
ta tam Tamil
te tel Telugu
tg tgk Tajik
th tha Thai
tk tuk Turkmen
tl tgl Tagalog
tr tur Turkish
tt tat Tatar
uk ukr Ukrainian
ur urd Urdu
uz uzb Uzbek
vi vie Vietnamese
yi yid Yiddish
yo yor Yoruba
zh chi,zho Chinese
zu zul Zulu"""


def _codes() -> dict[str, str]:
    out = {}
    for line in LANGUAGES.split("\n"):
        code, three, names = line.split(" ", 2)
        for key in (code, *three.split(","), *names.lower().split(",")):
            out[key] = code
    out.pop("-")
    return out


CODES = _codes()
NAMES = {line.split(" ")[0]: line.split(" ", 2)[2].split(",")[0] for line in LANGUAGES.split("\n")}
#: English names, longest first; "lao" is both a name and a code.
_ENGLISH = sorted((n for line in LANGUAGES.lower().split("\n") for n in line.split(" ", 2)[2].split(",")), key=lambda n: (-len(n), n))
_SHORT = "|".join(sorted(k for k in CODES if len(k) < 4))


def code_map() -> Column:
    return F.create_map(*[F.lit(x) for k, v in sorted(CODES.items()) for x in (k, v)])


def normalised(c: Column) -> Column:
    return F.element_at(code_map(), F.lower(F.trim(c)))


def declared(c: Column) -> Column:
    """A declared language: a code or name, else the longest name that it starts with."""
    low = F.lower(F.trim(c))
    starts = F.coalesce(*[F.when(low.startswith(n), F.lit(CODES[n])) for n in _ENGLISH])
    return F.coalesce(F.element_at(code_map(), low), starts)


def from_path(path: Column) -> Column:
    """The first language token of the file's stem, else the nearest folder that is a language."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    token = F.element_at(F.filter(F.split(F.lower(stem), r"[^\p{L}]+"), lambda x: x != ""), 1)
    folders = F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    near = F.filter(F.transform(folders, lambda f: F.element_at(code_map(), F.lower(f))), lambda x: x.isNotNull())
    return F.coalesce(F.element_at(code_map(), token), F.get(near, F.lit(0)))


def from_title(title: Column) -> Column:
    """The earliest whole-word name or marked code; a title mostly in Cyrillic is Russian."""
    low = F.lower(title)
    name_at = [F.when(low.rlike(rf"(?<!\p{{L}}){n}(?!\p{{L}})"), F.struct(F.regexp_instr(low, F.lit(rf"(?<!\p{{L}}){n}(?!\p{{L}})")).alias("at"), F.lit(CODES[n]).alias("code"))) for n in sorted(_ENGLISH)]
    marked = rf"(?<!\p{{L}})(?:({_SHORT})(?=\s?[-_‐‑‒–—−]\s?(?:{_SHORT})(?!\p{{L}}))|(?<=[(\[{{])({_SHORT})(?=[)\]}}]))"
    code = F.regexp_extract(low, marked, 0)
    code_at = F.when(code != "", F.struct(F.regexp_instr(low, F.lit(marked)).alias("at"), F.element_at(code_map(), code).alias("code")))
    best = F.array_min(F.array_compact(F.array(*name_at, code_at)))["code"]
    cyrillic = F.regexp_count(title, F.lit(r"\p{IsCyrillic}")) > F.regexp_count(title, F.lit("[A-Za-z]"))
    return F.coalesce(best, F.when(cyrillic, F.lit("ru")))


def resolved(declared_: Column, path: Column, title: Column) -> Column:
    return F.coalesce(declared(declared_), from_path(path), from_title(title))


def two_languages(text: Column) -> Column:
    """first and second language of the first pair that a title or name states: two language words joined by a
    dash, an arrow, a slash or an underscore, else the one-character names of a Chinese or Japanese title; null without one."""
    # A pair may begin with the second word of what is none: every word is tried as the first.
    words = F.regexp_extract_all(text, F.lit(r"(\p{L}{2,})(?=[ \t]*[-–—>_/][ \t]*\p{L}{2,})"), F.lit(1))
    nexts = F.regexp_extract_all(text, F.lit(r"\p{L}{2,}[ \t]*[-–—>_/][ \t]*(?=(\p{L}{2,}))"), F.lit(1))
    both = F.transform(F.arrays_zip(words.alias("w"), nexts.alias("n")), lambda x: F.struct(normalised(x["w"]).alias("first"), normalised(x["n"]).alias("second")))
    found = F.get(F.filter(both, lambda x: x["first"].isNotNull() & x["second"].isNotNull()), F.lit(0))
    names = "[" + "".join(HAN) + "]"
    han = F.regexp_extract_all(text, F.lit(rf"({names}{names})(?:[大中小]?(?:词典|詞典|辞典|辭典|字典|辞書|辭書)|双解|雙解)"), F.lit(1))
    # The sign that is also "and" names Japanese beside English alone.
    own = F.get(F.filter(han, lambda x: ~x.contains("和") | x.isin("英和", "和英")), F.lit(0))
    of = F.create_map(*[F.lit(x) for k, v in HAN.items() for x in (k, v)])
    return F.coalesce(found, F.when(own.isNotNull(), F.struct(F.element_at(of, F.substring(own, 1, 1)).alias("first"), F.element_at(of, F.substring(own, 2, 1)).alias("second"))))


#: One-character names of languages in Chinese and Japanese titles.
HAN = {"英": "en", "汉": "zh", "漢": "zh", "中": "zh", "俄": "ru", "日": "ja", "法": "fr", "德": "de", "韩": "ko", "韓": "ko", "意": "it", "葡": "pt", "拉": "la", "和": "ja"}


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)(?:\.[^.]*)?(?:\.(?:dz|gz))?$", "")


def folder_languages(path: Column, roots: Column) -> Column:
    """The pair that the nearest enclosing folder is named as, up to the configured root it is under; else of its own folder alone."""
    parts = F.split(F.regexp_replace(path, "/[^/]*$", ""), "/")
    folder = F.array_join(parts, "/")
    inside = F.filter(roots, lambda r: (r != "") & ((folder == r) | F.startswith(folder, F.concat(r, F.lit("/")))))
    # The nearest root stops the walk; the root's own name still counts.
    depth = F.coalesce(F.array_max(F.transform(inside, lambda r: F.size(F.split(r, "/")))), F.size(parts))
    names = F.reverse(F.slice(parts, F.greatest(depth, F.lit(1)), F.greatest(F.size(parts) - depth + 1, F.lit(0))))
    return F.get(F.filter(F.transform(names, two_languages), lambda x: x.isNotNull()), F.lit(0))


def stated_pair(declared_: Column, contents: Column, title: Column, path: Column, roots: Column) -> Column:
    a, b = declared(declared_), declared(contents)
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("first"), b.alias("second"))), two_languages(title), two_languages(_stem(path)), folder_languages(path, roots))


def pair_of(stated: Column) -> Column:
    """The undirected id of a pair of languages, or the one language of a monolingual one."""
    a, b = stated["first"], stated["second"]
    return F.when(stated.isNull(), None).when(a == b, a).otherwise(F.concat(F.least(a, b), F.lit("-"), F.greatest(a, b)))


def pair(title: Column) -> Column:
    """The two languages of a bilingual title as one undirected id, or Monolingual; null without a pair."""
    found = two_languages(title)
    return F.when(found["first"] == found["second"], "Monolingual").otherwise(pair_of(found))


def article_language(declared_: Column, contents: Column, title: Column, path: Column, roots: Column) -> Column:
    """The language of the articles: as declared, else the second of a stated pair, else that of the headwords."""
    return F.coalesce(declared(contents), two_languages(title)["second"], two_languages(_stem(path))["second"], folder_languages(path, roots)["second"], resolved(declared_, path, title))


def language_name(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (k, v)]), code)


def derived(dictionaries: DataFrame, rules: DataFrame) -> DataFrame:
    """dict_id, facet, place, value and label of every group a dictionary belongs to: its language, its pair and what rules say.
    dictionaries: dict_id, name, path, declared, contents and roots (an array)."""
    lang = resolved(F.col("declared"), F.col("path"), F.col("name"))
    stated = stated_pair(F.col("declared"), F.col("contents"), F.col("name"), F.col("path"), F.col("roots"))
    own = dictionaries.withColumn("_lang", lang).withColumn("_pair", stated)
    first, second = language_name(F.col("_pair.first")), language_name(F.col("_pair.second"))
    label = F.when(F.col("_pair.first") == F.col("_pair.second"), F.concat(F.lit("Monolingual "), first)).when(F.lower(first) <= F.lower(second), F.concat(first, F.lit(" ↔ "), second)).otherwise(F.concat(second, F.lit(" ↔ "), first))
    group = lambda facet, place, v, l: F.struct(F.lit(facet).alias("facet"), F.lit(place).alias("place"), v.alias("value"), l.alias("label"))
    both = F.filter(F.array(group("lang", 1, F.col("_lang"), language_name(F.col("_lang"))), group("pair", 2, pair_of(F.col("_pair")), label)), lambda g: g["value"].isNotNull())
    rows = own.select("dict_id", F.explode(both).alias("g")).select("dict_id", "g.*")
    return rows.unionByName(apply_rules(dictionaries, rules).select("dict_id", "facet", F.lit(3).alias("place"), F.lower("group_name").alias("value"), F.col("group_name").alias("label")))


def lexical(form: Column, name: Column, tags: Column) -> Column:
    """Whether a dictionary holds words rather than articles about things: every format but ZIM (also behind the mark of a prepared one), and there what calls itself a Wiktionary."""
    says = lambda c: F.coalesce(F.contains(F.lower(c), F.lit("wiktionary")), F.lit(False))
    return (F.regexp_replace(form, "^[a-z]+:", "") != "zim") | says(name) | says(tags)


def parse_rules(text: str) -> tuple[list[tuple[str, str, str, str]], list[str]]:
    """(facet, group, kind, pattern) rows of a rules file, and what could not be read."""
    rows, problems, section = [], [], ""
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line[0] in "#;":
            continue
        if line[0] == "[":
            section = line.strip("[]").strip()
            continue
        name, eq, items = line.partition("=")
        if not eq or not section:
            problems.append(f"line {number}: not a rule")
            continue
        for item in _items(items):
            kind, value = ("regex", item[1:-1]) if item[:1] == item[-1:] == "`" and len(item) > 1 else ("sub", item.lower())
            if value:
                rows.append((section, name.strip(), kind, value))
    return rows, problems


def _items(text: str) -> list[str]:
    out, own, quoted = [], "", False
    for c in text:
        if c == "`":
            quoted = not quoted
        if c == "," and not quoted:
            out.append(own.strip())
            own = ""
        else:
            own += c
    return [x for x in [*out, own.strip()] if x]


def apply_rules(dictionaries: DataFrame, rules: DataFrame) -> DataFrame:
    """dict_id, facet and group of every rule that a title or file name satisfies. The rules are the short side
    of the one theta join: they come from a rules file of at most a few hundred lines."""
    title, name, pattern = F.lower("name"), F.lower(F.element_at(F.split("path", "/"), -1)), F.col("pattern")
    hit = F.when(F.col("kind") == "sub", F.contains(title, pattern) | F.contains(name, pattern)).otherwise(F.rlike(title, F.concat(F.lit("(?i)"), pattern)) | F.rlike(name, F.concat(F.lit("(?i)"), pattern)))
    return dictionaries.join(F.broadcast(rules), hit).select("dict_id", "facet", "group_name").distinct()


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
