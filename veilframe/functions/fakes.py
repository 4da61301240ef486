"""Realistic stand-ins, computed from a value's ordinal and a secret.

Each type has a space of ``size`` values. A keyed Feistel network permutes the ordinals
of a group and type over it: two halves of the ordinal, each below the square root of the
size, are mixed in rounds, and what falls outside the space is mixed again until it is
inside. So ordinals up to the size never meet, all values are used before the space is exhausted, their
order tells nothing without the secret, and a repeated task gives the same value.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import let

# --- Fixed values: pools of invented stand-ins
SURNAMES = [
    "Белов", "Волков", "Громов", "Данилов", "Ершов", "Жаров", "Зимин", "Исаев", "Краснов", "Лаптев",
    "Марков", "Носов", "Орлов", "Панин", "Рыбаков", "Серов", "Титов", "Уваров", "Фомин", "Хохлов",
    "Чехов", "Шилов", "Щеглов", "Юдин", "Яшин", "Балашов", "Гусев", "Климов", "Минаев", "Суханов",
]
FIRST_NAMES = [
    "Антон", "Богдан", "Виктор", "Герман", "Денис", "Егор", "Захар", "Иван", "Кирилл", "Леонид",
    "Максим", "Никон", "Олег", "Прохор", "Роман", "Семён", "Тимур", "Фёдор", "Эдуард", "Яков",
]
PATRONYMICS = [
    "Антонович", "Богданович", "Викторович", "Германович", "Денисович", "Егорович", "Захарович",
    "Иванович", "Леонидович", "Максимович", "Олегович", "Романович", "Семёнович", "Тимурович",
    "Фёдорович",
]
CITIES = [
    "Светлогорск", "Каменск", "Озёрск", "Лесной", "Зареченск", "Полянск", "Речной", "Солнечный",
    "Степной", "Луговой", "Северск", "Восточный", "Заозёрск", "Боровск", "Ручейск", "Ключи",
    "Дубрава", "Песчаный", "Родниково", "Сосновка",
]
STREETS = [
    "Садовая", "Лесная", "Полевая", "Школьная", "Новая", "Заречная", "Парковая", "Солнечная",
    "Луговая", "Вишнёвая", "Озёрная", "Рябиновая", "Кленовая", "Берёзовая", "Мирная", "Южная",
]
COMPANIES = [
    "Вектор", "Горизонт", "Кристалл", "Меридиан", "Орбита", "Парус", "Ромашка", "Спектр", "Фрегат",
    "Эталон",
]
COMPANY_FORMS = ["ООО", "АО", "ПАО", "ЗАО"]
LOGINS = ["anton", "boris", "denis", "egor", "fedor", "ivan", "kirill", "maxim", "oleg", "roman"]
SURNAMES_LATIN = ["belov", "volkov", "gromov", "ershov", "isaev", "markov", "orlov", "serov"]
MAIL_HOSTS = ["example.com", "example.org", "example.net", "mail.example", "post.example"]
PLATE_RU = "АВЕКМНОРСТУХ"
PLATE_LATIN = "ABEKMHOPCTYX"
# -----------------------------------------------------------------------------

# --- Fixed values: formats. Each marker stands for one character of its alphabet.
ALPHABETS = {
    "#": "0123456789",
    "%": "123456789",
    "@": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "&": "ABCDEFGHJKLMNPRSTUVWXYZ0123456789",
    "^": PLATE_RU,
    "~": PLATE_LATIN,
}
FORMATS = {
    "PHONE_RU": "+7 9## ###-##-##",
    "SNILS_RU": "%##-###-### ##",
    "PASSPORT_RU": "%### ######",
    "INTL_PASSPORT_RU": "%# #######",
    "KPP_RU": "%########",
    "BANK_ACCOUNT_RU": "4%##################",
    "BIK_RU": "04#######",
    "CREDIT_CARD": "4##############",
    "DRIVER_LICENSE_RU": "%# %# %#####",
    "OMS_RU": "%###############",
    "VIN": "XWRZZ&&&&&&&&&&&&",
    "AADHAAR_IN": "%### %### %###",
    "PAN_IN": "@@@@@####@",
    "VOTER_ID_IN": "@@@#######",
    "PASSPORT_IN": "@#######",
    "GSTIN_IN": "%#@@@@@####@1Z#",
    "DRIVING_LICENSE_IN": "@@##20#########",
    "PHONE_IN": "+91 %#########",
    "IFSC_IN": "@@@@0######",
}
# Types whose stand-in has as many digits as the original: shorter and longer form.
BY_LENGTH = {
    "INN_RU": ("%#########", "%###########"),
    "OGRN_RU": ("%############", "%##############"),
}
# -----------------------------------------------------------------------------

# Rounds of the network, and how often it is walked at most: two halves below WALK leave fewer
# places outside the space than that, and larger ones so few that no walk comes near it.
# They are taken LEG steps at a time.
ROUNDS, WALK, LEG = 4, 200, 10


def _size_of(template: str) -> int:
    return math.prod(len(ALPHABETS.get(c, "x")) for c in template)


def _picks(template: str, *options: list[str]) -> tuple[str, int]:
    """``template`` filled with one pick per list, and the number of combinations."""
    picks, div = [], 1
    for o in options:
        listed = ", ".join(f"'{x}'" for x in o)
        picks.append(f"array({listed})[cast(_idx div {div} % {len(o)} as int)]")
        div *= len(o)
    return f"concat({template.format(*picks)})", div


def _count(low: int, size: int, div: int) -> str:
    return f"cast(_idx div {div} % {size} + {low} as string)"


def _worded() -> dict[str, tuple[str, int]]:
    """Stand-ins put together from words."""
    address, places = _picks("'г. ', {0}, ', ул. ', {1}, ', д. ', HOUSE, ', кв. ', FLAT", CITIES, STREETS)
    address = address.replace("HOUSE", _count(1, 100, places)).replace(
        "FLAT", _count(1, 150, places * 100)
    )
    mail, boxes = _picks("{0}, '.', {1}, NUMBER, '@', {2}", LOGINS, SURNAMES_LATIN, MAIL_HOSTS)
    return {
        "PERSON": _picks("{0}, ' ', {1}, ' ', {2}", SURNAMES, FIRST_NAMES, PATRONYMICS),
        "ADDRESS_RU": (address, places * 100 * 150),
        "EMAIL_ADDRESS": (mail.replace("NUMBER", _count(1000, 9000, boxes)), boxes * 9000),
        "RU_ORGANIZATION": _picks(
            "{1}, ' «', {0}, ' ', {2}, '»'", COMPANIES, COMPANY_FORMS, STREETS
        ),
        "RU_LOCATION": _picks(
            "{1}, {0}", CITIES, ["", "Ново-", "Старо-", "Верхне-", "Нижне-"]
        ),
    }


WORDED = _worded()


def _template() -> str:
    """The format of a row's stand-in; a plate keeps the shape of the original."""
    shape = "original"
    for chars, marker in (("0-9", "#"), ("А-Яа-яЁё", "^"), ("A-Za-z", "~")):
        shape = f"regexp_replace({shape}, '[{chars}]', '{marker}')"
    cases = [f"when '{ty}' then '{f}'" for ty, f in FORMATS.items()]
    for ty, (short, long) in BY_LENGTH.items():
        cases.append(
            f"when '{ty}' then if(length(original) = {len(short)}, '{short}', '{long}')"
        )
    return f"case ty {' '.join(cases)} else if(ty like 'VEHICLE_%', {shape}, null) end"


def _size() -> str:
    """How many values the row's format or words can give."""
    words = " ".join(f"when '{ty}' then {size}" for ty, (_, size) in WORDED.items())
    factors = "1"
    for marker, chars in ALPHABETS.items():
        times = f"(length(_form) - length(replace(_form, '{marker}', '')))"
        factors += f" * cast(power({len(chars)}, {times}) as decimal(20,0))"
    sizes = sorted({f for f in FORMATS.values()} | {f for pair in BY_LENGTH.values() for f in pair})
    exact = " ".join(f"when '{f}' then {_size_of(f)}" for f in sizes)
    return (
        f"cast(case when _form is null then case ty {words} else 1 end "
        f"else case _form {exact} else {factors} end end as decimal(20,0))"
    )


def _filled() -> str:
    """Any format with every marker replaced, last one first."""
    alphabets = " ".join(f"when '{m}' then '{chars}'" for m, chars in ALPHABETS.items())
    parts = (
        "transform(filter(split(reverse(_form), ''), c -> c <> ''), "
        f"c -> named_struct('c', c, 'set', case c {alphabets} end))"
    )
    text = (
        f"aggregate({parts}, named_struct('i', _idx, 'out', ''), (a, x) -> named_struct("
        "'i', coalesce(a.i div length(x.set), a.i), 'out', concat(coalesce("
        "substr(x.set, cast(a.i % length(x.set) as int) + 1, 1), x.c), a.out)), a -> a.out)"
    )
    return text


def _filled_in(form: str) -> str:
    """The same for a format that is known beforehand: digits of the ordinal's place, with no search for markers."""
    done, div = [], 1
    for piece in reversed(re.findall("#+|.", form)):
        chars = ALPHABETS.get(piece[0])
        if chars is None:
            done.append(f"'{piece}'")
        elif piece[0] == "#":
            done.append(f"lpad(cast(_idx div {div}L % {10 ** len(piece)}L as string), {len(piece)}, '0')")
            div *= 10 ** len(piece)
        else:
            done.append(f"substr('{chars}', cast(_idx div {div}L % {len(chars)}L as int) + 1, 1)")
            div *= len(chars)
    return f"concat({', '.join(reversed(done))})"


def _card_digit(payload: str) -> str:
    """The check digit that makes ``payload`` a valid card number."""
    weighted = (
        f"transform(filter(split(reverse({payload}), ''), c -> c <> ''), (c, i) -> "
        "case when i % 2 = 1 then int(c) when int(c) > 4 then int(c) * 2 - 9 "
        "else int(c) * 2 end)"
    )
    return f"cast((10 - aggregate({weighted}, 0, (a, x) -> a + x) % 10) % 10 as string)"


def fallback() -> str:
    """A token no generator makes, different for every ordinal of a type."""
    return "concat('[', ty, '_', lpad(cast(n as string), greatest(4, length(cast(n as string))), '0'), ']')"


def _mixed(digest: str, half: str, i: str) -> str:
    salted = f"concat('{digest}', ':', {i}, ':', group_id, ':', ty, ':', coalesce(_form, ''), ':', {half})"
    return f"cast(conv(substr(sha2({salted}, 256), 1, 15), 16, 10) as bigint)"


def _permuted(digest: str) -> str:
    """The ordinal's place in the space, from 0; null beyond its size."""
    network = (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', s.l, 'r', s.r), (t, j) -> "
        f"named_struct('l', t.r, 'r', (t.l + {_mixed(digest, 't.r', 'j')} % _side) % _side))"
    )
    step = f"transform(array({network}), t -> named_struct('l', t.l, 'r', t.r, 'out', t.l * _side + t.r >= _size))[0]"
    # The first step, which nearly all ordinals end with, has its halves in names of their own.
    left, right = f"_h{ROUNDS}", f"_h{ROUNDS + 1}"
    start = f"named_struct('l', {left}, 'r', {right}, 'out', true)"
    # The others go on in short walks.
    walk = f"aggregate(if(s.out, sequence(1, {LEG}), array()), s, (s, i) -> if(s.out, {step}, s))"
    walked = f"aggregate(sequence(1, {WALK // LEG}), {start}, (s, j) -> {walk}, s -> if(s.out, null, s.l * _side + s.r))"
    place = let(f"{left} * _side + {right}", "_at", f"if(_at < _size, _at, {walked})")
    for j in range(ROUNDS, 0, -1):
        mixed = _mixed(digest, f"_h{j}", str(j))
        place = let(f"(_h{j - 1} + {mixed} % _side) % _side", f"_h{j + 1}", place)
    halves = let("(n - 1) div _side", "_h0", let("(n - 1) % _side", "_h1", place))
    return f"if(n between 1 and _size, {halves}, null)"


def stand_ins(numbered: DataFrame, secret: str) -> DataFrame:
    """``numbered`` (group_id, norm, ty, n, original) with ``token``, the n-th stand-in of its
    group and type; null where the type has fewer."""
    # The plan holds a digest that serves stand-ins only, never the secret.
    digest = hashlib.sha256(f"fakes:{secret}".encode()).hexdigest()
    words = " ".join(f"when '{ty}' then {sql}" for ty, (sql, _) in WORDED.items())
    known = " ".join(f"when '{ty}' then {_filled_in(form)}" for ty, form in FORMATS.items())
    for ty, (short, long) in BY_LENGTH.items():
        known += f" when '{ty}' then if(length(original) = {len(short)}, {_filled_in(short)}, {_filled_in(long)})"
    generated = f"(_form is not null or ty in ({', '.join(repr(ty) for ty in WORDED)}))"
    root = "cast(ceil(sqrt(cast(_size as double))) as bigint)"
    side = f"{root} + if({root} * {root} < _size, 1, 0)"
    token = f"if(_idx is null, null, if(_form is null, case ty {words} end, case ty {known} else {_filled()} end))"
    # Bound names are worked out once; columns would be put into one another by the optimiser.
    made = token
    for value, name in ((_permuted(digest), "_idx"), (side, "_side"), (f"cast({_size()} as bigint)", "_size"), (_template(), "_form")):
        made = let(value, name, f"if({generated}, {made}, {fallback()})" if name == "_form" else made)
    card = let(made, "_t", f"if(ty = 'CREDIT_CARD', concat(_t, {_card_digit('_t')}), _t)")
    return numbered.withColumn("n", F.col("n").cast("bigint")).withColumn("token", F.expr(card))
