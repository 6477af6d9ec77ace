"""Generated training text for the tagger of personal information: invented values in invented surroundings."""

from __future__ import annotations

import random
import re

LABELS = ["other", "email", "phone", "id_number", "street_address", "person_name"]

#: Given names of many languages. Surnames, streets and towns are built from syllables.
GIVEN = """
Aaliyah Adam Agnes Ahmed Aiko Aisha Akira Alba Alejandro Alice Alina Amara Amelie Amina Ana Anders Andrea Anna Anselm Anton
Antonio Aoife Arjun Astrid Ayesha Beatriz Bianca Boris Bram Brigitte Camille Carlos Carmen Cecilia Chen Chiara Chloe Clara Colm
Dagmar Daniel David Deepa Diego Dmitri Dorothea Edith Einar Elena Elif Elsa Emeka Emily Emma Enzo Erik Esther Fatima Felix Fenna
Fiona Francesca Frida Gabriel George Giulia Greta Gustav Hana Hannah Haruka Hassan Heidi Helena Henrik Hugo Ibrahim Ilse Imani Ines
Ingrid Irina Isabel Ivan Jakob James Jana Javier Joana John Jorun Jose Juan Julia Kamal Karin Katarzyna Kenji Khadija Kofi Krzysztof
Kwame Lars Laura Leila Lena Liam Linda Lucia Luis Magda Malik Marek Maria Maribel Marta Mary Mateo Mei Michael Mireille Mohammed Nadia
Naomi Natalia Niamh Nikolai Noor Nora Olga Oliver Omar Orla Ottilie Pablo Paolo Patricia Paul Pedro Petra Pierre Priya Rafael Rafe
Rania Ravi Renata Robert Rosa Ruth Samira Sanjay Sara Selma Sergei Sigrid Simone Sofia Stefan Susan Sven Tariq Teodor Teresa Thomas
Tobin Tomasz Ursula Valentina Victor Wanda Wei William Xavier Yasmin Yuki Yusra Zainab Zoe
""".split()

#: What streets are called, before and after their name.
STREET_AFTER = "Street St Road Rd Avenue Ave Lane Ln Drive Dr Court Ct Terrace Close Boulevard Blvd Way Place Pl Square Crescent Row Hill".split()
STREET_BEFORE = ["Calle", "rue", "rue de", "rue du", "Via", "ul.", "Rua", "Avenida", "avenue de", "Plaza", "Corso"]
STREET_JOINED = ["straße", "strasse", "weg", "gasse", "allee", "platz", "gatan", "straat"]
UNITS = ["Apt", "Apt.", "Unit", "Flat", "Suite", "Apartment", "No."]

_STARTS = "b bel br c cor d dal dr el f fal fen g gre h hal hol j k kar l lin m mar mor n nor o os p pel qu r ros ruth s str sten t tar th ul v ven w wes y yar z zel".split()
_MIDDLES = "a e i o u an en in or ar ling ming ber don the lo ro ka qua ver nni tra llo bro do ga mi".split()
_ENDS = "sen ski ska ez er ers wyn well vale man mane more rost quist bade lund berg stein ov ova ini etti eau ard der dahl son ton field by thal worth hede nder".split()
_TOWNS = "bridge ford port ton wick mere marrow ham bury field burg ville stadt haven mouth stead".split()
_LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ACCENTS = {"a": "áâãä", "e": "éèêë", "i": "íîï", "o": "óôöø", "u": "úûü", "n": "ñ", "c": "ç"}

_NAME_TEXTS = """
{N} at the {w} was so kind|I asked {N} about it|thanks {N}|Many thanks to {N} for the help|my friend {N} loves it|{N} from support replied|- {N}|~{N}
love, {N}|Best, {N}|signed {N}|Signed, {N}|my name is {N}|My name is {N} and I {w} it|hi {N}!|Hello {N}, it is {w}|{N}'s advice|it was {N}'s {w}|with {N}|({N})
ask for {N} at the {w}|Dr {N} suggested it|Dr. {N} gave me this|Ms. {N} called|Mrs. {N} from next door|Mr {N} sent it back|{N} and I bought two
{N}|{N} recommended it|{N} told me so|my sister {N} swears on it|my doctor {N} said no|the manager, {N}, shrugged|my nurse {N} {w} {w}|{N}: no, it did not
for {N}: yes it {w}|as {N} said over tea|I got this from {N}|written by {N}|reviewed by {N}, a regular|{N}, regular customer|idea by {N}|({w}: {N})|P.S. hello {N}
met {N} on holiday|bought with {N} on the trip|{N} who helped me|my colleague {N} {w}|{w} {w} {N} {w} {w}|{w} {w}, {N}, {w} {w}|{w} {w} {N}|{N} {w} {w} {w}|{N}, {w} {w}
""".strip().replace("\n", "|").split("|")
_EMAIL_TEXTS = """
mail me at {E}|write to {E} please|{E}|({E})|my address is {E}|contact: {E}|mailto:{E}|e-mail={E};thanks|no answer from {E} yet|they used {E} for spam
questions? {E}!|{w} {w} {E} {w} {w}|send pictures to {E}, they said|{w} {w} {E}...|email {E} for a swap|{E} is my inbox|the receipt went to {E} {w} {w}
""".strip().replace("\n", "|").split("|")
_PHONE_TEXTS = """
call me at {P}|phone {P}|tel {P}|Tel. {P}|tel:{P}|my number is {P}|{P}|({P})|ring {P}|pls call{P}|text {P} any time|their hotline {P} is dead|{P}, evenings only
a call from {P}|WhatsApp {P}|fax {P}|the label said {P} for help|{w} {w} {P} {w} {w}|{P} is my mobile|reach us on {P} after five|I left {P} with them
the line gave me {P}|lost it, {P} is me|ring {P}, ask for me|got a message from {P} {w} {w}|dial {P} before you {w}|the helpline {P} {w} useless
""".strip().replace("\n", "|").split("|")
_ADDRESS_TEXTS = """
ship it to {A}|I live at {A}|Address: {A}|{A}|({A})|we moved to {A} and {w}|my place is {A}|delivered to {A} by mistake|pick it up at {A}, ring twice|near {A}
left at {A}|the shop at {A}|label: {A}|{w} {w} {A} {w} {w}|{A} is where I stay|living at {A} here|a {w} in my building, {A}, has it|send the other one to {A}.
""".strip().replace("\n", "|").split("|")
_ID_TEXTS = """
SSN {S}|my ssn is {S}|ssn {S} on a form|my social, {S}, was asked|social security number {S}|({S} is my ssn)|s.s.n. {S}|the social security no. {S}|{S} under my name
{S} on my form|why is {S} printed here|mine is {S}|passport {Q}|my passport {Q} got wet|passport no. {Q}|driver's licence {L}|licence {L} was in the bag|driving license {L}
my license no. {L} {w}|ID card {I}|ID card number {I}, if needed|identity card {I}|national id {I}|personal ID {I} {w}|show ID (no. {X})|my ID no. {X}|ID {X}|Tax ID {T} please
tax number {T}|taxpayer id {T}|National insurance {K}|National insurance no. {K} was on it|NI number {K}|insurance number {K}|resident permit {X}|{w} {w} {S} {w} {w}
""".strip().replace("\n", "|").split("|")
_OTHER_TEXTS = """
Order #{9} came late|order {9} is missing|Order no. {9}|order #{10} was late|order no. {10}|parcel {10}|parcel {7} took days|tracking {4} {4} {4}, slow|tracking number {a}{a}{9}{a}{a}|Batch {4}-{3}, use by {2}/20{2}|batch {a}{7}|lot {a}{a}{7}
lot {a}{7}|Lot no. {6}|LOT {a}{6}{a}|Coupon SKIN-{4}-{2} failed|coupon code {a}{a}{4}|code {6} did not work|Barcode {12} would not scan|barcode {13}|EAN {13}|article {6}|article no. {7}|item {8}
Shade {3}-{2} N|shade {3}|formula v{1}.{1}.{2}|version {1}.{1}|Paid ${2}.{2} for it|${2}|{2}.{2} USD|{1}.{1} fl oz / {2} ml|{2} ml|from {2}-{2}-20{2} to {2}-{2}-20{2}|on {2}/{2}/20{2}|since 20{2}-{2}-{2}
{1}/10|{2}/10|{1}.{1} out of 5|{1} out of 5|{2} % off|{3} points in the app|{2} hours|{1}-{1} times a day|SPF {2}|used {1} times|aisle {2}, shelf {1}|open {2} hours a day
Tagged @{u}_{2}|follow @{u}|saw it @ the {w}|sold @ the store|#{w}{w}|invoice {6}|model {a}{a}{4}|serial {9}|ref. {8}|receipt no. {7}|ticket {6}|pack of {1}|size {2}|the year 20{2}|model no. {7}
drive-through {w}|the lane at the {w}|on the road again|by the street {w}|row by row|close to {w}|street style|the court of {w}|a long way|drive me mad|my place|down the hill|square jar|a flat lid|unit price|{2} hour lane
{B} beats the rest|my {B} order|{B} again|by {B}|love {B}|from {B}, {w}|a {B} {w} {w}|{B} still {w} {w}|gone by April|in May|since June|on Monday|next Sunday|in March|rose and ivy|a hint of jade|ruby red|lily and amber|olive and sage
in {O}|the shop in {O}|a trip to {O}|near {O}|the {O} branch|from {O}
""".strip().replace("\n", "|").split("|")


def syllables(r: random.Random, ends: list[str]) -> str:
    return (r.choice(_STARTS) + "".join(r.choice(_MIDDLES) for _ in range(r.choice((0, 1, 1, 1, 2)))) + r.choice(ends)).capitalize()


class Writer:
    """Writes labelled texts over a vocabulary of ordinary sentences."""

    def __init__(self, seed: int, sentences: list[str], brands: list[str]):
        self.r = random.Random(seed)
        self.sentences = sentences or ["I like it very much.", "it is not for me"]
        self.words = sorted({w for s in self.sentences for w in re.findall(r"[^\W\d_]{2,}", s)}) or ["jar"]
        self.brands = brands or ["Acme"]

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def surname(self) -> str:
        s = syllables(self.r, _ENDS)
        return s + "-" + syllables(self.r, _ENDS) if self.r.random() < 0.12 else s

    def name(self) -> str:
        r, given, last = self.r, self.r.choice(GIVEN), self.surname()
        if r.random() < 0.1:
            i = r.randrange(1, len(given))
            given = given[:i] + r.choice(_ACCENTS.get(given[i], given[i])) + given[i + 1 :]
        if r.random() < 0.1:
            given = syllables(r, ["a", "o", "ie", "an", "e", "us", "el", "ín", "ë", "ía"])
        return r.choice([given, f"{given} {last}", f"{given} {last}", f"{given} {r.choice(_LATIN)}. {last}", f"{last}, {given}", last, last, f"{r.choice(_LATIN)}. {last}", f"Mrs. {last}", f"Mr. {last}"])

    def email(self) -> str:
        r, at, dot = self.r, "@", "."
        if r.random() < 0.35:
            at, dot = r.choice([(" (at) ", " (dot) "), (" at ", " dot "), ("[@]", "."), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" at ", ".")])
        given, last = r.choice(GIVEN).lower(), self.surname().lower().replace("-", r.choice("-._"))
        user = r.choice([given + self.digits(2), f"{given}.{last}", f"{given}_{last}", f"{last}_{given}", given[0] + last, last, f"{given}+{r.choice(self.words).lower()}", last + self.digits(1)])
        host = r.choice(["example", "mail.example", "post.example", syllables(r, _ENDS).lower() + r.choice(["", "mail", "post"]), "inbox"])
        return user + at + f"{host}.{r.choice(['com', 'net', 'org', 'test', 'de', 'example', 'co.uk', 'invalid', 'fr', 'io'])}".replace(".", dot)

    def phone(self) -> str:
        d, r = self.digits, self.r
        a, b, c = str(r.randint(2, 9)) + d(2), r.choice(["555", d(3)]), d(4)
        return r.choice([
            f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+1 {a} {b} {c}", f"1-{a}-{b}-{c}", f"001-{a}-{b}-{c} x{d(2)}", f"{a}{b}{c}", f"1{a}{b}{c}", f"{b}-{c}", f"{a}-{b}-{c} ext. {d(2)}",
            f"+44 20 {d(4)} {c}", f"0{d(4)} {d(6)}", f"07{d(3)} {d(6)}", f"+33 {r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+49 {d(3)} {d(7)}", f"{a} {b} {d(2)} {d(2)}", f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}",
        ])

    def address(self) -> str:
        r, street = self.r, syllables(self.r, _ENDS + _TOWNS + ["a", "o", "i", "e", "brook", "field"])
        n = str(r.randint(1, 2400))
        kind = r.random()
        if kind < 0.55:
            text = f"{n} {r.choice(['', '', '', r.choice('NSEW') + '. '])}{street} {r.choice(STREET_AFTER)}"
            if r.random() < 0.25:
                text = f"{r.choice(['Flat', 'Unit', 'Apt'])} {r.randint(1, 40)}, {text}"
            elif r.random() < 0.3:
                text += f", {r.choice(UNITS)} {r.randint(1, 240)}{r.choice(['', r.choice('ABCDEF')])}"
        elif kind < 0.8:
            text = f"{r.choice(STREET_BEFORE)} {street} {n}" if r.random() < 0.6 else f"{n} {r.choice(STREET_BEFORE)} {street}"
        else:
            text = f"{street}{r.choice(STREET_JOINED)} {n}"
        return text + (f", {self.town()}" if r.random() < 0.2 else "") + ("." if r.random() < 0.05 else "")

    def town(self) -> str:
        return self.r.choice(["North", "East", "West", "South", "Old", "New", "", "", ""]) .strip() + syllables(self.r, _TOWNS).lower() if self.r.random() < 0.3 else syllables(self.r, _TOWNS)

    def identity(self, kind: str) -> str:
        d, r, up = self.digits, self.r, lambda n: "".join(self.r.choice(_LATIN) for _ in range(n))
        if kind == "S":
            return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{d(3)}.{d(2)}.{d(4)}", d(9)])
        if kind == "Q":
            return up(r.choice((1, 2))) + d(7)
        if kind == "L":
            return r.choice([f"{up(1)}{d(3)}-{d(4)}-{d(2)}", f"{up(1)}{d(7)}", f"{up(2)}{d(6)}", f"{up(1)}{d(3)} {d(4)} {d(2)}"])
        if kind == "I":
            return r.choice([f"{d(4)}-{up(2)}-{d(2)}-{d(4)}", f"{up(2)}{d(7)}", f"{up(3)}{d(6)}", f"{d(4)}-{d(4)}-{d(4)}"])
        if kind == "T":
            return r.choice([f"{d(2)}-{d(7)}", f"{d(2)} {d(7)}", d(10)])
        if kind == "K":
            return r.choice([f"{up(2)} {d(2)} {d(2)} {d(2)} {up(1)}", f"{up(2)}{d(6)}{up(1)}"])
        return up(r.choice((1, 2))) + d(6) + r.choice(["", up(1), up(1) + d(1)])

    def fill(self, template: str) -> tuple[str, list[tuple[int, int, int]]]:
        out, spans = "", []
        for part in re.split(r"(\{\w+\})", template):
            if not re.fullmatch(r"\{\w+\}", part):
                out += part
                continue
            slot, label = part[1:-1], 0
            if slot == "N":
                value, label = self.name(), 5
            elif slot == "E":
                value, label = self.email(), 1
            elif slot == "P":
                value, label = self.phone(), 2
            elif slot == "A":
                value, label = self.address(), 4
            elif slot in "SQLITKX":
                value, label = self.identity(slot), 3
            elif slot == "w":
                value = self.r.choice(self.words)
            elif slot == "B":
                value = self.r.choice(self.brands)
            elif slot == "O":
                value = self.town()
            elif slot == "a":
                value = self.r.choice(_LATIN)
            elif slot == "u":
                value = self.r.choice(self.words).lower()
            else:
                value = self.digits(int(slot))
            if label:
                spans.append((len(out), len(out) + len(value), label))
            out += value
        return out, spans

    def typo(self, s: str) -> str:
        if len(s) < 5 or self.r.random() > 0.12:
            return s
        i = self.r.randrange(len(s) - 1)
        if self.r.random() < 0.08:
            return s.replace(" ", "")
        return s[:i] + s[i + 1] + s[i] + s[i + 2 :]

    def text(self) -> tuple[str, list[tuple[int, int, int]]]:
        """A text and its labelled spans: ordinary sentences with none to two inserts, in one of many letter cases."""
        r = self.r
        parts: list[tuple[str, list]] = [(self.typo(r.choice(self.sentences)), []) for _ in range(r.choice((0, 1, 1, 2)))]
        kept = None
        for _ in range(r.choice((1, 1, 2))):
            group = r.choices([_NAME_TEXTS, _EMAIL_TEXTS, _PHONE_TEXTS, _ADDRESS_TEXTS, _ID_TEXTS, _OTHER_TEXTS], [4, 2, 2.5, 2.5, 3, 6])[0]
            insert, spans = self.fill(r.choice(group))
            names = [insert[a:b] for a, b, label in spans if label == 5]
            if r.random() < 0.5:
                insert = insert[:1].upper() + insert[1:]
            insert += r.choice([".", ".", "", "", "!", "..."])
            if parts and r.random() < 0.25 and " " in parts[-1][0]:
                at = [m.start() for m in re.finditer(" ", parts[-1][0])]
                cut = r.choice(at)
                before, after = parts[-1][0][:cut] + " (", ")" + parts[-1][0][cut:]
                if not parts[-1][1]:
                    parts[-1] = (before + insert + after, [(a + len(before), b + len(before), k) for a, b, k in spans])
                    continue
            parts.insert(r.randrange(len(parts) + 1), (insert, spans))
            kept = names[0] if names else kept
        if kept and r.random() < 0.4:
            last = kept.split()[-1]
            s = r.choice(["{} was right", "so said {}", "{} again", "no reply from {} since"])
            parts.append((s.format(last), [(s.index("{"), s.index("{") + len(last), 5)]))
        out, labels = "", []
        for s, spans in parts:
            if out:
                out += r.choice([" ", " ", " ", "\n"])
            labels += [(a + len(out), b + len(out), k) for a, b, k in spans]
            out += s
        change = r.random()
        cased = out.lower() if change < 0.14 else out.upper() if change < 0.19 else out.title() if change < 0.22 else out.swapcase() if change < 0.23 else out
        return (cased if len(cased) == len(out) else out), labels
