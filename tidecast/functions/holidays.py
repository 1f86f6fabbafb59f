"""Public holidays by rule: fixed dates, n-th weekdays, days from Easter, and observed days."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

#: Rules by country: name, then (month, day), (month, weekday from Monday 0, n-th or -1 for the last), days from Easter, or
#: (month, day, "before", weekday) for the last such weekday before a day; an optional first year. Fixed values.
RULES: dict[str, tuple[tuple, ...]] = {
    "US": (
        ("New Year's Day", (1, 1)), ("Martin Luther King Jr. Day", (1, 0, 3)), ("Washington's Birthday", (2, 0, 3)), ("Memorial Day", (5, 0, -1)),
        ("Juneteenth National Independence Day", (6, 19), 2021), ("Independence Day", (7, 4)), ("Labor Day", (9, 0, 1)), ("Columbus Day", (10, 0, 2)),
        ("Veterans Day", (11, 11)), ("Thanksgiving Day", (11, 3, 4)), ("Christmas Day", (12, 25)),
    ),
    "DE": (
        ("New Year's Day", (1, 1)), ("Good Friday", -2), ("Easter Monday", 1), ("Labor Day", (5, 1)), ("Ascension Day", 39), ("Whit Monday", 50),
        ("German Unity Day", (10, 3), 1990), ("Christmas Day", (12, 25)), ("Second Day of Christmas", (12, 26)),
    ),
    "GB": (
        ("New Year's Day", (1, 1)), ("Good Friday", -2), ("Easter Monday", 1), ("May Day", (5, 0, 1), 1978), ("Spring Bank Holiday", (5, 0, -1)),
        ("Summer Bank Holiday", (8, 0, -1)), ("Christmas Day", (12, 25)), ("Boxing Day", (12, 26)),
    ),
    "FR": (
        ("New Year's Day", (1, 1)), ("Easter Monday", 1), ("Labor Day", (5, 1)), ("Victory Day", (5, 8)), ("Ascension Day", 39), ("Whit Monday", 50),
        ("National Day", (7, 14)), ("Assumption Day", (8, 15)), ("All Saints' Day", (11, 1)), ("Armistice Day", (11, 11)), ("Christmas Day", (12, 25)),
    ),
    "ES": (
        ("New Year's Day", (1, 1)), ("Epiphany", (1, 6)), ("Good Friday", -2), ("Labor Day", (5, 1)), ("Assumption Day", (8, 15)), ("National Day", (10, 12)),
        ("All Saints' Day", (11, 1)), ("Constitution Day", (12, 6)), ("Immaculate Conception", (12, 8)), ("Christmas Day", (12, 25)),
    ),
    "IT": (
        ("New Year's Day", (1, 1)), ("Epiphany", (1, 6)), ("Easter Sunday", 0), ("Easter Monday", 1), ("Liberation Day", (4, 25)), ("Labor Day", (5, 1)),
        ("Republic Day", (6, 2)), ("Assumption Day", (8, 15)), ("All Saints' Day", (11, 1)), ("Immaculate Conception", (12, 8)), ("Christmas Day", (12, 25)), ("Saint Stephen's Day", (12, 26)),
    ),
    "AT": (
        ("New Year's Day", (1, 1)), ("Epiphany", (1, 6)), ("Easter Monday", 1), ("Labor Day", (5, 1)), ("Ascension Day", 39), ("Whit Monday", 50), ("Corpus Christi", 60),
        ("Assumption Day", (8, 15)), ("National Day", (10, 26)), ("All Saints' Day", (11, 1)), ("Immaculate Conception", (12, 8)), ("Christmas Day", (12, 25)), ("Saint Stephen's Day", (12, 26)),
    ),
    "NL": (
        ("New Year's Day", (1, 1)), ("Easter Sunday", 0), ("Easter Monday", 1), ("King's Day", (4, 27), 2014), ("Ascension Day", 39), ("Whit Sunday", 49), ("Whit Monday", 50),
        ("Christmas Day", (12, 25)), ("Second Day of Christmas", (12, 26)),
    ),
    "BE": (
        ("New Year's Day", (1, 1)), ("Easter Monday", 1), ("Labor Day", (5, 1)), ("Ascension Day", 39), ("Whit Monday", 50), ("National Day", (7, 21)), ("Assumption Day", (8, 15)),
        ("All Saints' Day", (11, 1)), ("Armistice Day", (11, 11)), ("Christmas Day", (12, 25)),
    ),
    "PL": (
        ("New Year's Day", (1, 1)), ("Epiphany", (1, 6), 2011), ("Easter Sunday", 0), ("Easter Monday", 1), ("Labor Day", (5, 1)), ("Constitution Day", (5, 3)), ("Whit Sunday", 49),
        ("Corpus Christi", 60), ("Assumption Day", (8, 15)), ("All Saints' Day", (11, 1)), ("Independence Day", (11, 11)), ("Christmas Day", (12, 25)), ("Second Day of Christmas", (12, 26)),
    ),
    "CA": (("New Year's Day", (1, 1)), ("Good Friday", -2), ("Canada Day", (7, 1)), ("Labor Day", (9, 0, 1)), ("Christmas Day", (12, 25))),
    "AU": (("New Year's Day", (1, 1)), ("Australia Day", (1, 26)), ("Good Friday", -2), ("Easter Monday", 1), ("Anzac Day", (4, 25)), ("Christmas Day", (12, 25)), ("Boxing Day", (12, 26))),
}
_SAINTS, _CORPUS, _EPIPHANY, _REFORMATION = ("All Saints' Day", (11, 1)), ("Corpus Christi", 60), ("Epiphany", (1, 6)), ("Reformation Day", (10, 31))
#: What subdivisions have besides. Fixed values.
SUBDIVISIONS: dict[str, dict[str, tuple[tuple, ...]]] = {
    "DE": {
        "BW": (_EPIPHANY, _CORPUS, _SAINTS), "BY": (_EPIPHANY, _CORPUS, ("Assumption Day", (8, 15)), _SAINTS), "BE": (("International Women's Day", (3, 8), 2019),),
        "BB": (("Easter Sunday", 0), ("Whit Sunday", 49), _REFORMATION), "HB": ((*_REFORMATION, 2018),), "HH": ((*_REFORMATION, 2018),), "HE": (_CORPUS,),
        "MV": (("International Women's Day", (3, 8), 2023), _REFORMATION), "NI": ((*_REFORMATION, 2018),), "NW": (_CORPUS, _SAINTS), "RP": (_CORPUS, _SAINTS),
        "SL": (_CORPUS, ("Assumption Day", (8, 15)), _SAINTS), "SN": (_REFORMATION, ("Repentance and Prayer Day", (11, 23, "before", 2))), "ST": (_EPIPHANY, _REFORMATION),
        "SH": ((*_REFORMATION, 2018),), "TH": (_REFORMATION, ("World Children's Day", (9, 20), 2019)),
    },
    "GB": {
        "SCT": (("Second of January", (1, 2)), ("Saint Andrew's Day", (11, 30), 2006)), "NIR": (("Saint Patrick's Day", (3, 17)), ("Battle of the Boyne", (7, 12))),
    },
    "CA": {
        "ON": (("Family Day", (2, 0, 3), 2008), ("Victoria Day", (5, 25, "before", 0)), ("Thanksgiving Day", (10, 0, 2)), ("Boxing Day", (12, 26))),
        "QC": (("Easter Monday", 1), ("National Patriots' Day", (5, 25, "before", 0)), ("Saint-Jean-Baptiste Day", (6, 24)), ("Thanksgiving Day", (10, 0, 2))),
        "BC": (("Family Day", (2, 0, 3), 2019), ("Victoria Day", (5, 25, "before", 0)), ("British Columbia Day", (8, 0, 1)), ("Thanksgiving Day", (10, 0, 2))),
    },
    "AU": {
        "NSW": (("King's Birthday", (6, 0, 2)), ("Labor Day", (10, 0, 1))), "VIC": (("Labor Day", (3, 0, 2)), ("King's Birthday", (6, 0, 2)), ("Melbourne Cup Day", (11, 1, 1))),
        "QLD": (("Labor Day", (5, 0, 1)), ("King's Birthday", (10, 0, 1))),
    },
    "US": {"CA": (("Cesar Chavez Day", (3, 31), 1995),), "TX": (("Texas Independence Day", (3, 2)), ("San Jacinto Day", (4, 21))), "MA": (("Patriots' Day", (4, 0, 3)),)},
    "ES": {"MD": (("Community Day", (5, 2)), ("Maundy Thursday", -3)), "CT": (("Easter Monday", 1), ("Saint John's Day", (6, 24)), ("National Day of Catalonia", (9, 11)), ("Saint Stephen's Day", (12, 26)))},
    "FR": {"57": (("Good Friday", -2), ("Saint Stephen's Day", (12, 26))), "67": (("Good Friday", -2), ("Saint Stephen's Day", (12, 26))), "68": (("Good Friday", -2), ("Saint Stephen's Day", (12, 26)))},
}
OBSERVED = {"US"}


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar, from the age of the moon (the anonymous computus)."""
    golden, century, rest = year % 19, year // 100, year % 100
    epact = (19 * golden + century - century // 4 - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    sunday = (32 + 2 * (century % 4) + 2 * (rest // 4) - epact - rest % 4) % 7
    late = (golden + 11 * epact + 22 * sunday) // 451
    month, day = divmod(epact + sunday - 7 * late + 114, 31)
    return date(year, month, day + 1)


def _on(rule: tuple | int, year: int) -> date:
    if isinstance(rule, int):
        return easter(year) + timedelta(days=rule)
    if len(rule) == 2:
        return date(year, *rule)
    if len(rule) == 4:
        end = date(year, *rule[:2])
        return end - timedelta(days=(end.weekday() - rule[3] - 1) % 7 + 1)
    month, weekday, nth = rule
    if nth > 0:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (nth - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    return last - timedelta(days=(last.weekday() - weekday) % 7)


def holidays(country: str, years: Iterable[int], subdiv: str | None = None) -> list[tuple[date, str]]:
    """(date, name), sorted. Days at weekends add an observed row of their own name where the country has that custom."""
    if country not in RULES or (subdiv is not None and subdiv not in SUBDIVISIONS.get(country, {})):
        there = ", ".join(RULES if country not in RULES else SUBDIVISIONS.get(country, {}))
        raise NotImplementedError(f"no holidays for {country!r}{f' {subdiv!r}' if subdiv else ''}; there are {there}")
    rules = RULES[country] + (SUBDIVISIONS[country][subdiv] if subdiv is not None else ())
    out = []
    for year in sorted(set(years)):
        for name, rule, *since in rules:
            if since and year < since[0]:
                continue
            day = _on(rule, year)
            out.append((day, name))
            shift = {5: -1, 6: 1}.get(day.weekday())
            if shift and country in OBSERVED and isinstance(rule, tuple) and len(rule) == 2:
                out.append((day + timedelta(days=shift), f"{name} (observed)"))
    return sorted(out)


def register(country: str, rules: tuple[tuple, ...], observed: bool = False, subdiv: str | None = None) -> None:
    """Add a country's rules, or what a subdivision has besides, in the form of RULES."""
    if subdiv is not None:
        SUBDIVISIONS.setdefault(country, {})[subdiv] = rules
        return
    RULES[country] = rules
    if observed:
        OBSERVED.add(country)
