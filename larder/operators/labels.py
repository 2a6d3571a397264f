"""The lines of nutrition labels: numbers, nutrient names, headers and energies, all read with built-in expressions.

``labeltables`` puts the lines of a label together.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.scalars import KCAL_PER_KJ, half_up, normalise_label

# Names of nutrients on labels, normalised.  Vitamins' names follow a rule, below; further languages are a parameter.
SYNONYMS = {
    "energy": ("energy", "energie", "energia", "energi", "valeur energetique", "valor energetico", "valore energetico", "brennwert", "energetische waarde", "wartosc energetyczna", "energiaa", "calories", "kalorien", "calorias"),
    "fat": ("fat", "total fat", "fat total", "fett", "matieres grasses", "lipides", "grassi", "grassi totali", "grasas", "lipidos", "gordura", "gorduras", "vet", "vetten", "tluszcz", "materia grassa", "fedt", "rasva", "rasvaa", "zsir", "tuky"),
    "saturated-fat": ("saturated", "saturates", "saturated fat", "sat fat", "gesattigte fettsauren", "gesattigte", "acides gras satures", "satures", "acidi grassi saturi", "saturi", "saturadas", "grasas saturadas", "acidos grasos saturados", "saturados", "gordura saturada", "verzadigd", "verzadigde vetzuren", "kwasy tluszczowe nasycone", "mattat fett", "mettede fettsyrer"),
    "trans-fat": ("trans", "trans fat", "trans fatty acids", "trans fats", "acides gras trans", "grasas trans"),
    "monounsaturated-fat": ("monounsaturated", "monounsaturates", "mono unsaturates", "monounsaturated fat", "einfach ungesattigte fettsauren", "acides gras mono insatures", "monoinsaturi", "monoinsaturadas"),
    "polyunsaturated-fat": ("polyunsaturated", "polyunsaturates", "poly unsaturates", "polyunsaturated fat", "mehrfach ungesattigte fettsauren", "acides gras poly insatures", "polinsaturi", "poliinsaturadas"),
    "cholesterol": ("cholesterol", "cholesterin", "colesterol", "colesterolo"),
    "carbohydrates": ("carbohydrate", "carbohydrates", "total carbohydrate", "carbohydrate total", "carbs", "kohlenhydrate", "glucides", "carboidrati", "hidratos de carbono", "carbohidratos", "koolhydraten", "weglowodany", "kulhydrat", "kolhydrat", "karbohydrat", "sacharidy"),
    "sugars": ("sugars", "sugar", "total sugars", "zucker", "sucres", "zuccheri", "azucares", "acucares", "suikers", "cukry", "sukkerarter", "sockerarter"),
    "fiber": ("fibre", "fiber", "dietary fiber", "dietary fibre", "ballaststoffe", "fibres alimentaires", "fibres", "fibre alimentari", "fibra", "fibra alimentaria", "fibra alimentar", "vezels", "voedingsvezel", "blonnik", "kostfiber", "vlaknina"),
    "proteins": ("protein", "proteins", "eiweiss", "proteines", "proteine", "proteinas", "eiwitten", "bialko", "bilkoviny"),
    "salt": ("salt", "salz", "sel", "sale", "sal", "zout", "sol", "suola", "sul"),
    "sodium": ("sodium", "natrium", "sodio"),
    "potassium": ("potassium", "kalium", "potasio", "potassio"),
    "calcium": ("calcium", "calcio", "kalzium"),
    "iron": ("iron", "eisen", "fer", "ferro", "hierro"),
    "magnesium": ("magnesium", "magnesio"),
    "lactose": ("lactose", "lattosio", "lactosa", "laktose"),
    "sucrose": ("sucrose", "saccharose"),
    "glucose": ("glucose", "glukose"),
    "fructose": ("fructose", "fruktose"),
    "caffeine": ("caffeine", "koffein", "cafeine"),
    "alcohol": ("alcohol", "alkohol"),
    "vitamin-b1": ("thiamin", "thiamine", "tiamina"),
    "vitamin-b2": ("riboflavin", "riboflavine", "riboflavina"),
    "vitamin-pp": ("niacin", "niacine", "niacina", "vitamin b3"),
    "vitamin-b9": ("folate", "folic acid", "folsaure", "acide folique", "acido folico"),
    "zinc": ("zinc", "zink"),
    "phosphorus": ("phosphorus", "phosphor", "phosphore", "fosforo"),
}
#: Vitamins that are called by their letter, in English and German, French and Dutch, and Italian, Spanish and Portuguese.
_LETTERED = ("a", "c", "d", "e", "b1", "b2", "b6", "b9", "b12")


def synonyms(extra: dict[str, tuple[str, ...]] | None = None) -> dict[str, tuple[str, ...]]:
    """key -> names: the fixed ones, vitamins by their letters, and further ones."""
    found = {key: tuple(names) for key, names in SYNONYMS.items()}
    for letter in _LETTERED:
        found[f"vitamin-{letter}"] = found.get(f"vitamin-{letter}", ()) + tuple(f"{word} {letter}" for word in ("vitamin", "vitamine", "vitamina"))
    for key, names in (extra or {}).items():
        found[key] = found.get(key, ()) + tuple(names)
    return found


MATCH = 0.75
#: Names of at least so many characters may be read with errors; and as a run of words within other ones.
_SPELLED, _HIDDEN = 4, 5
#: A text and a name of lengths up to this much apart are compared as a whole, others run by run.
_LENGTHS_APART = 3
#: How much a run of words counts beside a whole text.
_RUN_WEIGHT = 0.95
# Words before a part of a nutrient; units as they are read and as they are meant.
_OF_WHICH = r"\b(of which|dont|davon|di cui|de las cuales|de los cuales|waarvan|including|incl|w tym|des quels|dos quais)\b"
_UNITS = {"cal": "kcal", "ca": "kcal", "k": "kj", "k3": "kj", "kl": "kj", "ing": "mg", "rng": "mg", "μg": "µg", "ug": "µg", "mcg": "µg"}
_PLAIN_UNITS = ("kj", "kcal", "mg", "µg", "g", "ml", "%")
_UNIT = "|".join(sorted([*_UNITS, *_PLAIN_UNITS], key=len, reverse=True))
#: A number that is no part of a name (B12, omega-3) or of a longer number, and its unit unless that begins a word.
_NUMBER = rf"(?i)(?<![\p{{L}}0-9.,])(?<!\p{{L}}[-‐])[0-9]+(?:[.,][0-9]+)?(?:\s*(?:{_UNIT}))?(?!\p{{L}})"


def _edits_within(size: int, likeness: float, weight: float) -> int:
    """The most edits that leave a name of a size the likeness, whatever the length of the other text (which they bound)."""
    share = min(1 - (likeness - size / 1000 - 0.001) / weight, 0.99)  # likenesses are rounded
    return int(share * size / (1 - share) + 1e-6)


def nearest_name(text: Column, extra: dict[str, tuple[str, ...]] | None = None, least: float = MATCH) -> Column:
    """struct(likeness, key) of the nutrient whose name is nearest to a normalised text, if the likeness is ``least`` or more; else some lower likeness.

    Equal texts have 1, a name contained as words 0.9; else what an edit distance leaves of the whole text if it is about
    as long as the name, and if it is not, of its best run of as many words as the name has, weighted 0.95.  Longer names
    get a little more.  The names are a fixed, small literal, so each row is matched where it is: no join and no shuffle.
    """
    names = [(key, name, name.count(" ") + 1) for key, own in synonyms(extra).items() for name in own]
    order = {key: -place for place, key in enumerate(synonyms(extra))}  # of equal likenesses the first nutrient's counts
    longest = max(n for _, _, n in names)

    def by_length(chosen: list[tuple[str, str, int]], most, apart: int) -> list[list[dict]]:
        """For each length of a text the names that it can be with so many edits, of lengths up to so much apart; others are not looked at."""
        fields = [{"key": key, "name": name, "words": f" {name} ", "size": len(name), "order": order[key], "most": most(len(name)), "more": len(name) / 1000} for key, name, _ in chosen]
        return [[f for f in fields if abs(f["size"] - length) <= min(f["most"], apart)] for length in range(max([f["size"] + f["most"] for f in fields], default=0) + 1)]

    # Each one text, which Spark folds to a constant: built of single literals, the tables would be most of the plan.
    kind = "array<array<struct<key:string,name:string,words:string,size:int,order:int,most:int,more:double>>>"
    whole = by_length([x for x in names if len(x[1]) >= _SPELLED], lambda size: _edits_within(size, least, 1.0), _LENGTHS_APART)
    edits = lambda size: _edits_within(size, least, _RUN_WEIGHT) if size >= _HIDDEN else 0
    by_run = [by_length([x for x in names if x[2] == n], edits, max(len(name) for _, name, _ in names)) for n in range(1, longest + 1)]
    whole, by_run = F.from_json(F.lit(json.dumps(whole)), kind), F.from_json(F.lit(json.dumps(by_run)), f"array<{kind}>")

    def told(words: Column) -> Column:
        runs = [F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " ")) for n in range(1, longest + 1)]  # noqa: B023
        none = F.array().cast("array<string>")
        runs = [F.when(F.size(words) >= n, run).otherwise(none) for n, run in enumerate(runs, 1)]
        text = F.array_join(words, " ")
        return F.struct(text.alias("text"), F.concat(F.lit(" "), text, F.lit(" ")).alias("words"), F.length(text).alias("length"), F.array(*runs).alias("runs"))

    def edits_left(a: Column, size: Column, n: Column) -> Column:
        edits = F.call_function("levenshtein", a, n["name"], n["most"])  # -1 beyond, which pmod makes a large number
        return F.lit(1.0) - F.pmod(edits, F.lit(1 << 20)) / F.greatest(size, n["size"])

    def scored(t: Column, table: Column, length: Column, likeness) -> Column:
        score = lambda n: F.when(F.contains(t["words"], n["words"]), 0.9).otherwise(likeness(n))
        return F.transform(F.coalesce(F.get(table, length), F.array()), lambda n: F.struct((n["more"] + score(n)).alias("likeness"), n["order"].alias("order"), n["key"].alias("key")))

    def best_of(t: Column) -> Column:
        """The best of the names that are about as long as the whole text, and of those that a run may be and that are not."""
        apart = lambda n: (F.abs(t["length"] - n["size"]) > _LENGTHS_APART) & (n["size"] >= _HIDDEN)
        hidden = lambda run: lambda n: F.when(apart(n), edits_left(run, F.length(run), n) * _RUN_WEIGHT).otherwise(0.0)
        of_runs = F.transform(t["runs"], lambda runs, k: F.flatten(F.transform(runs, lambda run: scored(t, F.get(by_run, k), F.length(run), hidden(run)))))
        return F.array_max(F.concat(scored(t, whole, t["length"], lambda n: edits_left(t["text"], t["length"], n)), F.flatten(of_runs)))

    # Bound as lambda variables, the text and the best name are worked out once and not once for each use.
    best = F.transform(F.transform(F.array(F.split(text, " ")), told), best_of)
    best = F.transform(best, lambda x: F.struct(half_up(x["likeness"], 4).alias("likeness"), x["key"].alias("key")))[0]
    # An equal name beats all others, so most lines are looked up and only the rest compared.
    equal: dict[str, dict] = {}
    for key, name, _ in names:
        equal.setdefault(name, {"likeness": round(1 + len(name) / 1000, 4), "key": key})
    return F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(equal)), "map<string,struct<likeness:double,key:string>>"), text), best)


def synonym_match(labels: DataFrame, extra: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """id, key, likeness of the nearest nutrient of each ``text``, if it is near enough."""
    return labels.select("id", label_match(F.col("text"), extra).alias("b")).where("b is not null").select("id", "b.key", "b.likeness")


def label_key(text: Column, extra: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The nutrient that a line of a label names, or null; names in several languages stand between slashes or bars."""
    return label_match(text, extra)["key"]


def label_match(text: Column, extra: dict[str, tuple[str, ...]] | None = None) -> Column:
    """struct(likeness, key) of the nutrient that a line names, or null; "of which" and the like, and numbers, do not count."""
    parts = F.split(F.regexp_replace(text, _NUMBER, " "), "[/|]")
    plain = lambda part: F.trim(F.regexp_replace(F.regexp_replace(normalise_label(part), rf"{_OF_WHICH}|\b[0-9]+\b", " "), " +", " "))
    plain = F.filter(F.transform(parts, plain), lambda part: F.length(part) > 1)
    # Bound as lambda variables, these are computed once for a line and not once for each name.
    return F.array_max(F.filter(F.transform(plain, lambda part: nearest_name(part, extra)), lambda x: x["likeness"] >= MATCH))


def label_numbers(text: Column) -> Column:
    """array of struct(value, unit): the numbers of a line."""
    return F.transform(label_tokens(text), lambda t: F.struct(t["value"].alias("value"), t["unit"].alias("unit")))


def label_tokens(text: Column) -> Column:
    """array of struct(value, unit, digits, at): the numbers of a line, their digits as read, and their middle's place in the line, 0 to 1.

    A capital O before a decimal mark or a unit is a zero, as is an o that is all of the line but its unit; a leading zero
    without a mark has lost it (02 is 0.2); a comma before three digits groups thousands of kJ, kcal or mg, else it is a
    decimal mark.
    """
    zero = F.regexp_replace(text, rf"(?<![\p{{L}}0-9])O(?=[.,]?[0-9]*\s?(?i:g|mg|µg|kj|kcal)\b)", "0")
    zero = F.regexp_replace(zero, r"(?i)^(\s*)o(\s?m?g\s*)$", "$10$2")

    def read(match: Column) -> Column:
        digits = F.regexp_extract(match, r"^[0-9.,]+", 0)
        spelled = F.lower(F.trim(F.regexp_replace(match, r"^[0-9.,]+", "")))
        unit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in _UNITS.items() for x in pair]), spelled), spelled)
        grouped = digits.rlike(r"^[1-9][0-9]?,[0-9]{3}$") & unit.isin("kj", "kcal", "mg")
        plain = F.when(digits.rlike("^0[0-9]+$"), F.regexp_replace(digits, "^0", "0.")).when(grouped, F.replace(digits, F.lit(","), F.lit(""))).otherwise(F.replace(digits, F.lit(","), F.lit(".")))
        return F.struct(plain.try_cast("double").alias("value"), unit.alias("unit"), digits.alias("digits"))

    def placed(x: Column) -> Column:
        letters = lambda strings, n: F.aggregate(F.slice(strings, F.lit(1), n), F.lit(0), lambda a, s: a + F.length(s))

        def token(match: Column, i: Column) -> Column:
            middle = letters(x["between"], i + 1) + letters(x["matches"], i) + F.length(match) / 2
            return read(match).withField("at", middle / F.greatest(F.length(x["line"]), F.lit(1)))

        return F.transform(x["matches"], token)

    matches = F.regexp_extract_all(zero, F.lit(f"({_NUMBER})"), F.lit(1))
    return F.transform(F.array(F.struct(zero.alias("line"), matches.alias("matches"), F.split(zero, _NUMBER).alias("between"))), placed)[0]


def _fits(kj: Column, kcal: Column) -> Column:
    expected = kcal / KCAL_PER_KJ
    return F.abs(kj - expected) <= F.greatest(F.lit(3.0), expected * 0.06)


def _without_line(value: Column) -> tuple[Column, Column]:
    """A number without a leading or a trailing 1, which may have been a line of the table."""
    text = value.cast("long").cast("string")
    front = F.when(text.startswith("1"), F.substring(text, 2, 20).try_cast("double"))
    return front, F.when(text.endswith("1"), F.substring(text, F.lit(1), F.length(text) - 1).try_cast("double"))


def repaired_kcal(kj: Column, kcal: Column) -> Column:
    """kcal that fit the kJ: as read, else without a 1 at either end, else as read."""
    front, back = _without_line(kcal)
    return F.when(_fits(kj, kcal), kcal).when(_fits(kj, front), front).when(_fits(kj, back), back).otherwise(kcal)


def repaired_energy(kj: Column, kcal: Column) -> Column:
    """kJ that fits the kcal: as read, else without a 1 at either end, else as read; kcal are repaired first."""
    front, back = _without_line(kj)
    return F.when(_fits(kj, kcal), kj).when(_fits(front, kcal), front).when(_fits(back, kcal), back).otherwise(kj)


def header(text: Column) -> tuple[Column, Column, Column]:
    """Basis (100 or serving), amount and unit of a column's header."""
    amount = F.regexp_extract(text, r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*(g|ml)\b", 1)
    number = F.replace(amount, F.lit(","), F.lit(".")).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"(?i)[0-9]\s*(g|ml)\b", 1))
    return F.when(number == 100, "100").when(number.isNotNull() | text.rlike("(?i)serving|portion"), "serving"), number, F.nullif(unit, F.lit(""))
