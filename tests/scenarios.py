"""Small document folders, one per control-flow pattern, written by the tests themselves."""

import json

TRACES = {
    "sequence": ["BLR"] * 5,
    "parallel": ["BLRZA", "BLRZA", "BRLZA", "BRLZA"],
    "loop": ["BRZ", "BRZ", "BR", "BR"],
    "choice": ["BLRZA"] * 4 + ["BRZPA"] * 2 + ["B"] * 4,
    "iteration": ["BLRZ", "BLR", "BRLBRL", "BRBLRL", "BRL", "BX"],
}

NAMES = {
    "B": "Bestellung",
    "L": "Lieferschein",
    "R": "Rechnung",
    "Z": "Zahlung",
    "A": "Abschluss",
    "P": "Abholschein",
    "X": "Ablehnung",
}


def _day(case: int, step: int) -> str:
    day = 1 + step * 4
    return f"{day % 28 + 1:02d}.{(case + day // 28) % 12 + 1:02d}.{2020 + (case + day // 28) // 12}"


def _entry(kind: str, case: int, step: int) -> dict:
    date = _day(case, step)
    base = {"Case_id": case + 100, "Bestellungsnummer": 7000 + case}
    products = [{"Produktid": 301 + (case + i) % 3, "Menge": 20041 + case * 10 + i} for i in range(2)]
    body = {
        "B": {"Kundennummer": 501 + case % 3, "Produkte": products, "Gesamtpreis": 900.5 + case, "Datum": date},
        "L": {"Lieferscheinid": f"LS-{case}-{step}", "Produkte": products, "Gesamtgewicht": 12.25, "Datum": date},
        "R": {"Gesamtbetrag": 950.75 + case, "Rabatt": 0.5, "Datum": date},
        "Z": {"Zahlungsreferenz": f"REF-{case}", "Kundennummer": 501 + case % 3, "Betrag": 950.75 + case, "Datum": date},
        "A": {"Abschlussnummer": f"AB-{case}", "Versanddatum": date},
        "P": {"Abholscheinid": f"AS-{case}", "Abholbereit": True, "Datum": date},
        "X": {"Bestätigung": False, "Voraussichtliches Lieferdatum": None, "Datum": date},
    }[kind]
    return {**base, **body}


def documents(name: str) -> list[tuple[int, str, str]]:
    """(doc_id, path, content) of a scenario with its master data."""
    out, counter = [], {}
    for case, trace in enumerate(TRACES[name]):
        for step, kind in enumerate(trace):
            counter[kind] = counter.get(kind, 0) + 1
            title = NAMES[kind]
            content = json.dumps({title: [_entry(kind, case, step)]}, ensure_ascii=False)
            out.append((len(out), f"/in/{title}/{title}{counter[kind]}.json", content))
    customers = [
        {"Kundennummer": 501 + i, "Name": f"Kunde {chr(65 + i)}", "Adresse": {"Ort": f"Ort {chr(65 + i)}"}}
        for i in range(3)
    ]
    products = [{"Produktid": 301 + i, "Bezeichnung": f"Ding {chr(65 + i)}", "Preis": 19.5 + i} for i in range(3)]
    for title, rows in (("Kunden", customers), ("Produkte", products)):
        out.append((len(out), f"/in/{title}.json", json.dumps({title: rows}, ensure_ascii=False)))
    return out


def case_of(name: str) -> dict[int, int]:
    out = {}
    for case, trace in enumerate(TRACES[name]):
        for _ in trace:
            out[len(out)] = case
    return out


def follows(name: str) -> dict[tuple[str, str], int]:
    out = {}
    for trace in TRACES[name]:
        for a, b in zip(trace, trace[1:], strict=False):
            key = (NAMES[a], NAMES[b])
            out[key] = out.get(key, 0) + 1
    return out
