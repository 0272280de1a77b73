"""Fits the weights of pii.py: python -m talklake.llm.train_pii FOLDER

The archive has no labelled rows. A sample of at most SAMPLE texts is made whose labels are known because the items were
planted: sentences of the folder's messages in which nothing can be an item, with items put into templates beside them or
in between, and decoys without items. Names, streets, towns, numbers and addresses are drawn from the lists and formats
below, half of all names from syllables, so that no list of names is learned; the known names take part as evidence, and
in a third of the texts they are hidden. Node and transition weights are fitted by gradient steps on the likelihood of
the chains; the skip potentials piecewise, from how often linked places of planted texts have which labels.
"""

from __future__ import annotations

import random
import re
import sys
from collections import Counter

import numpy as np

from .pii import ALONE, LABELS, N_LABELS, PAIRS, REACH, TYPES, WITH_NEIGHBOUR, Field, Names, Tagger, _shift, run_features, token_features

#: Bound of the sample; passes over it; texts a step; rate of steps; weight of the penalty.
SAMPLE, PASSES, STEP, RATE, DECAY = 50_000, 4, 256, 0.25, 2e-6
#: Features seen in fewer texts of the sample have no weight.
SEEN = 4

GIVEN = """Anna Ben Carla David Elena Felix Gina Hassan Irene Jakob Karin Luis Maria Nico Olga Pedro Rosa Samuel Tina Umar Vera Walter Xavier Yusuf Zoe Aisha Bruno Chloé Dmitri Esther
Fatima Georg Hana Igor Julia Kofi Laura Marek Nadia Oscar Paula Ravi Sofia Tomasz Ulrike Viktoria Wei Ximena Yuki Zeynep André Beatriz Cem Daniela Emil Françoise Günter Helga Inés Jürgen
Mark Will Grace Victor Hugo Max Rose Frank Sean Siobhán Lars Astrid Søren Mikael Aino Pekka Katarzyna Zsófia""".split()
FAMILY = """Smith Müller García Rossi Dubois Nowak Jensen Okonkwo Raman Tanaka Kowalski Silva Petrov Andersson Novák Horváth Popescu Yılmaz Haddad Nguyen Kim Chen Khan Mensah Oduya Becker
Schneider Wagner Hofmann Schäfer Moreau Lefèvre Girard Bonnet Romero Torres Navarro Iglesias Ferrari Bianchi Conti Greco Lindqvist Bergström Virtanen Mäkinen Larsen Dahl Vermeer Janssens
Brown Wilson Taylor Clarke Hughes Murphy Kelly Walsh Campbell Stewart Young Hill Marsh Field Stone Woods Brook Baker Fisher Hunter Ivanova Sokolov Kuznetsov Shevchenko Papadopoulos Georgiou Costa
Almeida Pereira Santos Johnston Whitfield Ashworth Blackwood Thornbury Goldstein Rosenberg Steinmann Hartmann Lindgaard Nygård Halvorsen Østergaard Beauchamp Desrosiers Montero Echeverría""".split()
TOWNS = """London Berlin Madrid Paris Rome Lisbon Hamburg Lyon Sevilla Porto Wien Zürich Leeds Bristol Dublin Oslo Uppsala Tampere Gdańsk Brno Graz Ulm Kiel Bonn Nantes Lille Rennes Toledo Bilbao
Springfield Riverside Fairview Greenville Ashford Millbrook Oakdale Hillcrest Lakeview Westport Northfield Eastwick Southgate Marburg Altstadt Neudorf""".split()
STREET_WORDS = """Oak Maple Baker Church Station High Main Park River Mill King Queen Victoria Market Castle Garden Spring Forest Lake Hill North South Elm Cedar Bridge School Chapel Abbey""".split()
GERMAN = """Goethe Schiller Linden Garten Bahnhof Kirch Berg Wald Mühlen Rosen Haupt Schul Garten Burg Post Ufer Wiesen Brunnen Dorf Feld""".split()
STREET_AFTER = "Street St St. Avenue Ave Ave. Road Rd Rd. Lane Ln Drive Dr Court Ct Close Terrace Way Boulevard Blvd Square Crescent Place Parkway".split()
STREET_JOINED = "straße strasse str. weg ring platz gasse allee damm ufer".split()
RUE = "rue avenue chemin allée boulevard place impasse quai route cours".split()
CALLE = "Calle Plaza Paseo Avda. Avenida Camino Ronda Via Viale Piazza C/ C/ Rúa Travesía".split()
TITLES = "Mr Mr. Ms Ms. Mrs Mrs. Mx Mx. Dr Dr. Prof Prof. Herr Frau Mme Mlle Monsieur Madame Sr. Sra. Señor Señora Don Doña Sir Professor".split()
ENDINGS = "son sen mann man stein berg field ford wood ley ton ova ov ska ski ez iguez etti ini oux ard dal lund vik ström gaard water shaw mere wick brand aker anen ahn rell ner ström gard er in o a".split()
THINGS = """cache mirror bot index parser ticket webhook archive queue dashboard build token digest channel release stream gateway backlog pipeline calendar template upload sponsor sticker""".split()
ADJECTIVES = "quiet broken remote final early stable partial weekly legacy odd huge local nightly private rotated drained".split()
ADVERBS = ["behind the feature flag", "with a fresh token", "before lunch", "since yesterday evening", "for the third time", "after the outage", "during the demo", "on slow connections", "if the queue is down"]

# slots: {n} name, {p} phone, {i} identity number, {a} address, {e} email; {t} a thing, {v} an adverb, {w} a made-up word
TEMPLATES = {
    "name": """signed, {n}|on behalf of {n}|{n} will call you {v}|Dear {n},|dear {n}, the {t} is late|thanks to {n} for the {t}|kudos to {n} for the {t}|photo by {n}|reviewer={n} state=open|author: {n}|contact {n} about the {t}
meeting with {n} {v}|attendees: {n}; notes in the {t}|interview notes for {n} are in the {t}|this was reported by {n}|I work with {n}, who broke the {t}|{n} will take over the {t}|({n}) the {t} is mine|“{n}” is on the guest list|was it {n} or the bot that touched the {t}?
my legal name is {n}|je suis {n}, bonjour|Grüße von {n}|gestern hat {n} das geprüft|gracias a {n} por the {t}|invoice was issued to {n} {v}|ask {n} {v}|cc {n}|Best regards, {n}|Mit freundlichen Grüßen\n{n}|Cordialement,\n{n}|{n} wrote the {t}
please forward it to {n}|our guest {n} arrives {v}|Kontakt: {n}|el autor es {n}|merci à {n} pour le {t}|have you met {n}?|{n} and {n} own the {t}|{n}, {n} and {n} joined|we hired {n} {v}|hat {n} den {t} gesehen?|— {n}|- {n}|{n}: the {t} is down|speaker {n} is ill
{n} said the {t} is fine|{n} approved it|according to {n} the {t} fails|{n}'s {t} is broken|assigned to {n}|from {n} to {n}|name={n};|name: {n}|Name {n}|patient {n}|"{n}" <{e}>|{n} <{e}>|{n}, {p}|{n}, {a}""",
    "phone": """call me on {p}|my number changed: {p}|reach the desk under {p}|the hotline {p} rings forever|sms to {p} never arrived|whatsapp {p} works too|appelle le {p} {v}|mi teléfono: {p}|nummer: {p} (nur {v})|{p} // the {t}|{p} if the {t} is down|the {t} {p} was muted|Tel. {p}|Telefon: {p}|tel: {p}|phone={p}
cell {p}|fax {p}|mobile: {p}|call {p} {v}|ruf {p} an|text me at {p}, please|contact: {p}|our number is {p}|llama al {p}|joignable au {p}|{p}|office {p} or {p}|dial {p}""",
    "id": """my SSN: {i} leaked|leaked again: {i}|copy of {i} was attached to the {t}|is {i} valid?|mine is {i} fyi|they stored {i} in the {t}|verification of {i} failed {v}|the form wants {i}|passport {i} got rejected {v}|mi documento {i} no pasa|por favor borra {i} de the {t}|id={i}; role=guest|id: {i}|national id {i}
social security number {i}|Social: {i}|Ausweisnummer {i}|personnummer {i}|passeport n° {i}|pasaporte {i}|DNI {i}|ID card {i}|Reisepass {i}|insurance number {i}|my passport no. is {i}|ssn={i}|NIE: {i}|the clerk copied {i}|{i} belongs to someone else""",
    "address": """ship it to {a}|deliver to {a} not to the office|the meetup is at {a}|we moved to {a} {v}|stickers go to {a} thanks|parcel for {a} came back {v}|I live at {a}, ring twice|Treffpunkt {a} wie immer|nueva sede: {a}|mon adresse : {a}|{a} is where the {t} is hosted|address: {a}|Adresse: {a}|send the {t} to {a}|label says {a}
home={a}|office at {a}|see you at {a} {v}|wir wohnen in der {a}|vivo en {a}|j'habite au {a}|{a}|billing address {a}|the courier waits at {a}|new office: {a}|come to {a} on Monday|ship the {t} to {a}""",
    "email": """write to {e} please|contact: {e}|does {e} exist?|{e} bounced again|unsubscribe {e} from the {t}|login={e} failed {v}|account <{e}> lost access|[{e}] bounced|schreib an {e} wegen the {t}|escríbeme a {e}|cc {e} on the {t}|forwarded from {e}|forwarded from {e} {v}|mail={e}; the {t}|the {t} {e} was muted|{e}|mailto:{e}|my address is {e}|écris à {e}|e-mail {e}""",
}
# no items: {g} a given name alone, {f} a family name alone, {1} to {9} that many digits
DECOYS = """ticket INC-{4}-{4} is about the {t}|order no. {6}|costs {2}.{2} per {4} calls, order no. {6}|peer 10.{3}.{2}.{3}:{5} dropped {v}|peer 10.{3}.{3}.{3}:{5} dropped {v}|host 192.{3}.{1}.{2} is down|{3}.{3}.{3}.{3}:{4}|from {2}.{3}.{3}.{2} {v}|from 2025-{2}-{2} to 2026-{2}-{2} we moved the {t}|message {9}{9} points to the {t}|trace {x} {v}|commit {h} touched {3} files in {w}/{w}|commit {9}a touched {2} files in {w}/{w}|commit {8}e{1} {v}|{h} is the last commit|{k} beats {k} {v}|{k} and {k}|the {k} {t}|{k}: {k}|we split {w} {t} {v}|the crew split {w} {t}
range {3}-{3} of the {t}, took {2}:{2}.{3}|pin {w}@{1}.{1}.{1} instead of {w}@{1}.{1}.{1}|pin {w}@{1}.{2}.{1} {v}|@{w}_{2} and @here please look at the {t}|thanks {g}, the {t} is fine|{g} said hi|hi {g}|@{g} ping|{g} and {g} are here|Will Call and Mark Ready are labels of the {t}|Grace Period and Max Value are fields of the {t}
we have {3} {t}s in lane {1} and {2} street lights on the map|Main Street was closed {v}|build {5} of {w} failed in {1}m{2}s|version {1}.{2}.{1} of {w}|see https://{w}.example.net/{w}/{5}|<@{9}{9}> ok|<@{9}{9}> {t}|<#{9}{9}> moved|{6}|{7}|{8} rows|{9} bytes|we 4{3} {3} eager builds {v}|{4} {1}.{2}.{1} of {w}
at {2}:{2} the {t} is up|price {3}.{2} EUR|on {2}/{2}/2024 the {t} broke|{2}.{2}.2024|2024-{2}-{2}T{2}:{2}:{2}Z|12 May 20{2}|on 7 June 20{2} {v}|March {2}, 20{2}|le 3 janvier 20{2}|am 24. Dezember 20{2}|el 5 de mayo de 20{2}|port {5}|pid {7}|id of the {t} is {6}|the {f} {t} is slow|{w} {t} meets {w} {t}|Black Friday {t}|Pull Request {4}|New York and {c} voted|in {c} it rains|the {c} {t}|road map for {4}|ISBN 978-{1}-{2}-{6}-{1}
meet at {2}:{2} {v}|lane {1} is free|room {3}, floor {1}|{3} {t}s on {2} streets|way {1} of {2}|line {4}, column {2}|at {w} dot com they said nothing|meet me at the {t}|look at the {t} {v}|{3}-{4} rows|step {1}-{2}-{3}|error {4}-{4}|sha {h}|ERR_{4}_{6}|user {w} joined|Dr. Who was on tv|Mr. Robot {t}|the doctor called {v}
score {3}:{3}|{1},{3},{3} rows|{2} {3} {3} rows|no. {8}|v{1}.{1}.{2}-rc{1}|{t}-{4}-{2}|{5}-{4}|job {9} done|seed {9}|epoch {9}{1}|{9}{1} ms|{9}{3}|order {3}-{7}-{7}|invoice {4}-{5}|SKU {3}-{2}-{4}x|part no. {3}.{3}.{3}.{2}"""


class Maker:
    """Planted texts with the extent and type of their items."""

    def __init__(self, seed: int, plain: list[str], known: list[tuple[str, str]]):
        self.r = random.Random(seed)
        self.plain = plain
        self.known_given = [n for n, p in known if p == "given" and n]
        self.known_family = [n for n, p in known if p == "family" and n]

    def word(self, low: int = 1, high: int = 3) -> str:
        r = self.r
        return "".join(r.choice("b c d f g h j k l m n p r s t v w z br cr dr gr pr st tr sh ch kl".split()) + r.choice("a e i o u a e i o ei au ou".split()) for _ in range(r.randint(low, high)))

    def given(self) -> str:
        k = self.r.random()
        return self.r.choice(GIVEN) if k < 0.4 else self.r.choice(self.known_given) if k < 0.6 and self.known_given else (self.word(1, 2) + self.r.choice(["", "n", "x", "l", "s", "ka", "ra", "yx"])).capitalize()

    def family(self) -> str:
        r, k = self.r, self.r.random()
        if k < 0.3 or len(self.known_family) < 2:
            return r.choice(FAMILY)
        if k < 0.45:
            return r.choice(self.known_family).capitalize()
        if k < 0.72:
            # a name like two known ones
            a, b = r.choice(self.known_family).lower(), r.choice(self.known_family).lower()
            return (a[: max(3, len(a) - r.choice((3, 4, 5)))] + b[-r.choice((3, 4, 5)) :]).capitalize()
        return (self.word(1, 2) + r.choice("r l n nd st m".split() + [""]) + r.choice(ENDINGS)).capitalize()

    def name(self) -> str:
        r = self.r
        g, f, k = self.given(), self.family(), r.random()
        if r.random() < 0.08:
            g += "-" + self.given()
        if r.random() < 0.08:
            f += "-" + self.family()
        elif r.random() < 0.04:
            f = r.choice(["von ", "van ", "de ", "van der ", "O'", "Mc", "al-", "della "]) + f
        i = r.choice("ABCDEFGHIJKLMNOPRSTVW")
        if k < 0.52:
            out = f"{g} {f}"
        elif k < 0.64:
            out = f"{g} {i}. {f}"
        elif k < 0.7:
            out = f"{i}. {f}"
        elif k < 0.84:
            out = f"{f}, {g}"
        elif k < 0.88:
            out = f"{f}, {i}."
        else:
            out = f
        k2 = r.random()
        if k2 < 0.1:
            out = out.lower()
        elif k2 < 0.15:
            out = out.upper()
        if k >= 0.88 or (k < 0.7 and r.random() < 0.15):
            return f"{r.choice(TITLES)} ⟦{out}⟧"
        return f"⟦{out}⟧"

    def common(self) -> str:
        """A word of a sentence without items."""
        words = [w for w in re.findall(r"[^\W\d_]+", self.r.choice(self.plain)) if len(w) > 3]
        return self.r.choice(words).lower() if words else "word"

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def phone(self, alone: bool = False) -> str:
        """A telephone number; one that stands alone, without words that tell it, isn't short."""
        r, d, k = self.r, self.digits, self.r.random() * (0.78 if alone else 1)
        s = r.choice(["  ", " ", " ", "-", ".", "\u00a0", ""])
        s = s[:1]
        if k < 0.36:
            cc = r.choice(["1", "44", "49", "33", "34", "39", "46", "81", "91", "351", "420"])
            groups = r.choice([(3, 3, 3), (1, 2, 2, 2, 2), (4, 6), (2, 8), (4, 3, 3), (3, 3, 4), (2, 3, 4), (3, 6), (2, 4, 4), (2, 5, 3), (3, 2, 2, 2), (10,), (9,), (2, 8), (4, 3, 4)])
            body = s.join(d(n) for n in groups)
            zero = r.choice(["", "", "", "(0)"]) if s else ""
            out = f"{r.choice(['+', '+', '00'])}{cc}{s}{zero}{body}"
            if r.random() < 0.15:
                out = f"+{cc} ({d(3)}) {d(3)}{r.choice('- ')}{d(4)}"
        elif k < 0.56:
            a, b, c = d(3), d(3), d(4)
            out = r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"1 ({a}) {b}-{c}"])
        elif k < 0.78:
            out = r.choice([f"0{d(2)}{r.choice([' ', '/', '-'])}{d(5)}{s}{d(3)}", f"0{d(3)}{r.choice([' ', '/', '-'])}{d(6)}", f"0{d(3)}/{d(5)}-{d(3)}", f"0{d(4)}{s}{d(6)}", f"0{d(4)}{s}{d(3)}{s}{d(3)}", f"0{d(1)}{s}{d(2)}{s}{d(2)}{s}{d(2)}{s}{d(2)}", f"0{d(2)} {d(7)}", f"0{d(1)} {d(4)} {d(4)}", f"0{d(2)} {d(8)}"])
        elif k < 0.92:
            out = r.choice([f"{d(3)}{s}{d(2)}{s}{d(2)}{s}{d(2)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)} {d(2)} {d(2)} {d(2)}", f"{d(4)} {d(4)}", f"{d(3)} {d(4)}", f"{d(3)}-{d(4)}", f"{d(3)}-{d(4)}"])
        else:
            out = f"{d(3)}-{d(4)}"
        out = f"⟦{out}⟧"
        if r.random() < 0.08:
            out = f"{out[:-1]}{r.choice([' ext. ', ' x', ', ext ', ' Durchwahl '])}{d(r.randint(2, 4))}⟧"
        if r.random() < 0.04:
            out = out.translate({48 + i: 0xFF10 + i for i in range(10)} | {43: 0xFF0B, 40: 0xFF08, 41: 0xFF09})
        if r.random() < 0.25:
            out = r.choice(["tel:", "tel: ", "Tel. ", "cell ", "phone ", "T: "]) + out
        return out

    def id(self) -> tuple[str, bool]:
        """An identity number; whether it needs a word that says so."""
        r, d, k = self.r, self.digits, self.r.random()
        cap = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTVWXYZ") for _ in range(n))
        s = r.choice([" ", " ", "", "-"])
        if k < 0.28:
            sep = r.choice("--- ")
            return f"⟦{d(3)}{sep}{d(2)}{sep}{d(4)}⟧", False
        if k < 0.4:
            return f"⟦{d(9)}⟧", True
        if k < 0.58:
            low = r.random() < 0.2
            c = cap(1).lower() if low else cap(1)
            return "⟦" + r.choice([f"{d(8)}{c}", f"{d(8)}-{c}", f"{d(2)}.{d(3)}.{d(3)}-{c}", f"{d(8)} {c}", f"{r.choice('XYZ')}{d(7)}{c}"]) + "⟧", False
        if k < 0.74:
            return "⟦" + r.choice([f"{cap(2)}{d(6)}{r.choice('ABCD')}", f"{cap(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{cap(2)} {d(6)} {r.choice('ABCD')}"]) + "⟧", False
        if k < 0.88:
            return "⟦" + r.choice([f"{d(6)}{r.choice('-+-')}{d(4)}", f"{d(6)}-{d(4)}", f"{d(8)}-{d(4)}"]) + "⟧", False
        return f"⟦{cap(r.choice((1, 1, 2, 2, 3)))}{s if s != '-' else ''}{d(r.choice((6, 7, 7, 8, 8)))}⟧", False

    LABELS = ["SSN ", "ssn: ", "Social: ", "passport ", "pasaporte ", "passeport n° ", "national id ", "ID card ", "personnummer ", "DNI ", "Reisepass ", "id ", "insurance no. ", "Ausweisnummer "]

    def identity(self) -> str:
        x, named = self.id()
        return self.r.choice(self.LABELS) + x if named or self.r.random() < 0.3 else x

    def town(self) -> str:
        k = self.r.random()
        return self.r.choice(TOWNS) if k < 0.35 else self.family() if k < 0.75 else (self.word(1, 2) + self.r.choice("burg ville ton ham dorf stadt by wick mouth port field mere".split())).capitalize()

    def address(self) -> str:
        r, d = self.r, self.digits
        no = str(r.randint(1, 250) if r.random() < 0.85 else r.randint(1, 9999)) + (r.choice("abc") if r.random() < 0.06 else "")
        who = r.choice(STREET_WORDS) if r.random() < 0.35 else self.family()
        k = r.random()
        unit = ""
        if k < 0.42:
            street = f"{no} {who} {r.choice(STREET_AFTER)}"
            unit = r.choice([f", Apt {r.randint(1, 40)}", f" #{r.randint(1, 40)}", f", Flat {r.randint(1, 9)}b", f", Unit {r.randint(1, 40)}", f", Suite {r.randint(1, 400)}"]) if r.random() < 0.4 else ""
        elif k < 0.5:
            street = f"{who} {r.choice(STREET_AFTER)} {no}"
        elif k < 0.565:
            street = f"{r.randint(1, 250)} {self.common()} {self.common()} {r.choice(STREET_AFTER).lower()}"
        elif k < 0.74:
            first = r.choice(GERMAN) if r.random() < 0.4 else self.family()
            no = no + r.choice("abcdef") if no.isdigit() and r.random() < 0.2 else no
            street = f"{first}{r.choice(STREET_JOINED)} {no}" if r.random() < 0.85 else f"{first}-{r.choice(['Straße', 'Weg', 'Platz', 'Allee'])} {no}"
        elif k < 0.87:
            street = f"{no}{r.choice(['', '', ',', ' bis', ' ter'])} {r.choice(RUE)} {r.choice(['', 'de la ', 'des ', 'du ', 'de ', 'd’', 'de l’'])}{who}"
        else:
            street = f"{r.choice(CALLE)} {r.choice(['', '', 'de la ', 'del ', 'de '])}{who}{r.choice([' ', ', ', ', nº '])}{r.randint(1, 250)}"
            unit = f", {r.randint(1, 9)}º {r.choice('ABCD')}" if r.random() < 0.4 else ""
        town = ""
        if r.random() < 0.65:
            t, z = self.town(), d(5)
            town = r.choice([f", {t}", f", {z} {t}", f", {t} {z}", f" in {z} {t}", f"\n{t} {z}", f", {z} {t}", f" in {t}"])
        out = street + unit + town
        k = r.random()
        return f"⟦{out.lower() if k < 0.08 else out.upper() if k < 0.11 else out}⟧"

    def email(self) -> str:
        r = self.r
        g, f = self.given().lower(), self.family().lower()
        g, f = re.sub(r"[^\w]", "", g), re.sub(r"[^\w]", "", f)
        user = r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{f}_{g}", f"{f}-{g[0]}", f"{g}.{r.choice('abcdefhk')}.{f}", f"{g}{r.randint(1, 99)}", f, f"{g}{f}", self.word(), f"{g}_{f}"])
        if r.random() < 0.15:
            user += "+" + r.choice(THINGS)
        domain = r.choice(["example.org", "example.com", "example.net", f"{self.word()}.test", f"mail.{self.word()}.example.net", f"{f}.invalid", f"{self.word()}.example", f"{self.word()}.de", f"{self.word()}-{self.word()}.co.uk", f"{self.word()}.io", "gmail.com"])
        out, k = f"{user}@{domain}", r.random()
        if k < 0.26:
            at, dot = r.choice([(" at ", " dot "), (" AT ", " DOT "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("{at}", "."), (" @ ", "."), ("(at)", "."), (" (at) ", " (dot) "), ("＠", "."), ("[at]", "[dot]")])
            out = user.replace(".", dot) + at + domain.replace(".", dot) if r.random() < 0.7 else user + at + domain.replace(".", dot)
        elif k < 0.36:
            out = out.title() if r.random() < 0.5 else out.upper()
        return f"⟦{out}⟧"

    def fill(self, text: str) -> str:
        """A template or decoy without item slots left: {t} and the like."""
        r = self.r

        def one(m: re.Match) -> str:
            c = m.group(1)
            if c.isdigit():
                return self.digits(int(c))
            if c in "npqiae":
                kind = {"n": "name", "p": "phone", "q": "phone", "i": "id_number", "a": "address", "e": "email"}[c]
                x = {"n": self.name, "p": self.phone, "q": lambda: self.phone(True), "i": self.identity, "a": self.address, "e": self.email}[c]()
                return x.replace("⟦", f"⟦{TYPES.index(kind)}")
            return {
                "t": lambda: f"{r.choice(ADJECTIVES)} {r.choice(THINGS)}" if r.random() < 0.5 else f"{self.word(2, 3)}{r.choice(['x', 'n', 'l', ''])} {r.choice(THINGS)}",
                "v": lambda: r.choice(ADVERBS), "w": lambda: self.word(2, 3) + r.choice(["x", "n", "l", ""]), "g": self.given, "f": self.family, "c": lambda: r.choice(TOWNS), "k": lambda: " ".join(self.common().capitalize() for _ in range(r.choice((1, 2, 2, 3)))),
                "x": lambda: "-".join("".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12)), "h": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((7, 10, 12)))),
            }[c]()

        return re.sub(r"\{(\w)\}", one, text)

    def sentence(self) -> str:
        r, k = self.r, self.r.random()
        if k < 0.34:
            return r.choice(self.plain)
        if k < 0.5:
            return self.fill(r.choice(DECOY_LIST))
        if k < 0.53:
            # numbers that mean nothing, in the middle of a sentence
            words = r.choice(self.plain).split(" ")
            at = r.randint(0, len(words))
            return self.fill(" ".join([*words[:at], r.choice(["{4} {4}", "{3} {4}", "{4} {1}.{2}.{1}", "{4}", "{3} {3}", "{4} {3}", "{2} {4} {3}", "{6}", "{4} 2"]), *words[at:]]))
        kind = r.choice(["name", "name", "phone", "id", "address", "address", "email"])
        if k < 0.65 and kind != "id":
            # an item in the middle of a sentence that has nothing to do with it
            words = r.choice(self.plain).split(" ")
            at = r.randint(0, len(words))
            slot = {"name": "n", "phone": "q", "address": "a", "email": "e"}[kind]
            return self.fill(" ".join([*words[:at], "{" + slot + "}" if kind != "name" else r.choice(["by {n}", "({n})", "{n}", "for {n}"]), *words[at:]]))
        t = r.choice(TEMPLATES[kind].replace("\n", "|").split("|") if kind != "name" else NAME_LIST)
        t = t.replace("\\n", "\n")
        t = t[:1].upper() + t[1:] if r.random() < 0.2 else t
        return self.fill(t)

    def text(self) -> tuple[str, list[tuple[int, int, int]]]:
        """(text, items as (start, end, type))."""
        r = self.r
        parts = [self.sentence() for _ in range(r.choice((1, 1, 2, 2, 3, 4)))]
        # an item that comes again without a context that tells it
        again = [m for p in parts for m in re.findall(r"⟦\d[^⟦⟧]*⟧", p)]
        if again and r.random() < 0.3:
            x = r.choice(again)
            words = r.choice(self.plain).split(" ")
            at = r.randint(0, len(words))
            parts.append(" ".join([*words[:at], x, *words[at:]]))
        called = [m for p in parts for m in re.findall(rf"⟦{TYPES.index('name')}([^⟦⟧]*)⟧", p)]
        if called and r.random() < 0.25:
            # one of a name's words alone, which is no item
            word = r.choice(re.findall(r"[^\W\d_]{2,}", r.choice(called)) or ["x"])
            parts.append(self.fill(f"{r.choice(['the', 'so', 'but', 'hi', 'why does', 'then'])} {word if r.random() < 0.7 else word.lower()} {r.choice(['{t} is slow', 'said no', '{t}', 'left early', 'wrote that'])}"))
        out = parts[0]
        for p in parts[1:]:
            out += r.choice([" ", ". ", "! ", "\n", ", ", " - ", "  ", "? "]) + p
        out += r.choice(["", "", ".", "!", "\n", " fyi"])
        if r.random() < 0.04:
            out = out.upper()
        clean, items, at = [], [], 0
        start = kind = None
        for piece in re.split(r"(⟦\d|⟧)", out):
            if piece[:1] == "⟦":
                start, kind = at, int(piece[1])
            elif piece == "⟧":
                items.append((start, at, kind))
            else:
                clean.append(piece)
                at += len(piece)
        return "".join(clean), items


NAME_LIST = TEMPLATES["name"].replace("\n{n}", "¶{n}").replace("\n", "|").replace("¶", "\n").split("|")
DECOY_LIST = DECOYS.replace("\n", "|").split("|")


def gold(toks: list[str], items: list[tuple[int, int, int]]) -> np.ndarray:
    """Labels of tokens that lie in items."""
    y, at = np.zeros(len(toks), np.int64), 0
    k = 0
    items = sorted(items)
    fresh = True
    for i, w in enumerate(toks):
        begin = at + len(w) - len(w.lstrip())
        while k < len(items) and begin >= items[k][1]:
            k, fresh = k + 1, True
        if k < len(items) and begin >= items[k][0] and w.strip():
            # signs before an item's first letter or digit are none of it
            if not (fresh and not w.strip()[0].isalnum()):
                y[i] = 2 * items[k][2] + (1 if fresh else 2)
                fresh = False
        at += len(w)
    return y


def plain_sentences(texts: list[str], names: Names) -> list[str]:
    """Sentences in which nothing can be an item: no long run of digits, no sign of an address, no word like a known name."""
    out = []
    for t in texts:
        for s in re.split(r"(?<=[.!?])\s+|\n+", t):
            s = s.strip()
            bare = re.sub(r"https?://\S+|<[@#]\S+>", "", s)
            if not 3 < len(s) < 300 or re.search(r"\d(?:\D?\d){5}|@|＠|\bat\b.*\bdot\b|[([{]at", bare, re.I):
                continue
            if any(f.startswith("known") or f in ("like-family=4", "like-family=3") for w in re.findall(r"[^\W\d_]{4,}", bare) for f in names.features(w.lower())):
                continue
            out.append(re.sub(r"(?<=\w)[.!?]$", "", s))
    return out


def fit(sample: list[tuple[str, list[tuple[int, int, int]]]], names: Names, seed: int = 1) -> Field:
    r = random.Random(seed)
    blank = Names.of([])
    taggers = [Tagger(EMPTY, names), Tagger(EMPTY, blank)]
    hidden = [r.random() < 0.33 for _ in sample]
    # features of the sample
    seen, seen_runs, seen_classes = Counter(), Counter(), Counter()
    encoded = []
    for (text, items), h in zip(sample, hidden):
        t = taggers[h]
        toks, flat, run_of, _ = t.encode([text])
        feats = set()
        inside = gold(toks[0], items)
        for w, y in zip(toks[0], inside):
            fs, kind = token_features(w, t.names)
            seen_classes[kind] += 1
            # the words of names and addresses aren't learned as such
            feats.update(f for f in fs if not (f.startswith("w=") and y in (9, 10)))
        seen.update(feats)
        back = {i: run for run, i in t.run_ids.items()}
        seen_runs.update({f for i in np.unique(run_of) if i for f in run_features(back[int(i)])})
        encoded.append((toks[0], inside))
    features = sorted(f for f, n in seen.items() if n >= SEEN)
    classes = [c for c, n in seen_classes.most_common(110)]
    runs = sorted(f for f, n in seen_runs.items() if n >= SEEN)
    print(len(features), "features,", len(runs), "of runs,", len(classes), "classes")
    n_c = len(classes) + 1
    field = Field(features, np.zeros((len(features), len(REACH), N_LABELS), np.float32), classes, np.zeros((len(PAIRS), n_c, n_c, N_LABELS), np.float32), runs, np.zeros((len(runs), N_LABELS), np.float32), np.zeros((N_LABELS, N_LABELS), np.float32), np.zeros((2, N_LABELS, N_LABELS), np.float32))
    bad = np.zeros((N_LABELS, N_LABELS), bool)
    for k in range(N_LABELS):
        for j in range(2, N_LABELS, 2):
            bad[k, j] = k not in (j, j - 1)
    field.step[bad] = -30
    # every distinct token once, as a list of its features
    docs = []
    kinds: dict[tuple[str, int], int] = {}
    lists: list[list[int]] = []
    class_of: list[int] = []
    run_lists: dict[str, list[int]] = {}
    for (text, _), h, (toks, y) in zip(sample, hidden, encoded):
        t = taggers[h]
        ids = []
        for w in toks:
            key = (w, h)
            if key not in kinds:
                kinds[key] = len(lists)
                fs, kind = token_features(w, t.names)
                lists.append([field.index[f] for f in fs if f in field.index])
                class_of.append(field.classes.get(kind, 0))
            ids.append(kinds[key])
        _, _, run_of, _ = t.encode([text])
        back = {i: run for run, i in t.run_ids.items()}
        rl = []
        for i in run_of:
            if i and back[int(i)] not in run_lists:
                run_lists[back[int(i)]] = [field.runs[f] for f in run_features(back[int(i)]) if f in field.runs]
            rl.append(back[int(i)] if i else "")
        docs.append((np.array(ids), y, rl))
    class_of_ = np.array(class_of, np.int64)
    width = max(map(len, lists))
    table = np.full((len(lists), width), len(features), np.int64)  # the last row is empty
    for i, x in enumerate(lists):
        table[i, : len(x)] = x
    rw = max(map(len, run_lists.values()), default=1)
    run_table, run_no = np.full((len(run_lists) + 1, rw), len(runs), np.int64), {"": 0}
    for run, x in run_lists.items():
        run_no[run] = len(run_no)
        run_table[run_no[run], : len(x)] = x
    n_f = len(features) + 1
    w = np.zeros((len(REACH) * n_f, N_LABELS), np.float32)
    pw = np.zeros((len(PAIRS) * n_c * n_c, N_LABELS), np.float32)
    rwt = np.zeros((len(runs) + 1, N_LABELS), np.float32)
    step = field.step.copy()
    sums = [np.full(x.shape, 1e-2, np.float32) for x in (w, pw, rwt, step)]
    from .pii import _blocks

    for epoch in range(PASSES):
        order = list(range(len(docs)))
        r.shuffle(order)
        loss = wrong = total = 0.0
        for lo in range(0, len(order), STEP):
            pick = [docs[k] for k in order[lo : lo + STEP] if len(docs[k][0])]
            flat = np.concatenate([d[0] for d in pick])
            y = np.concatenate([d[1] for d in pick])
            run = np.array([run_no[x] for d in pick for x in d[2]])
            length = np.array([len(d[0]) for d in pick])
            starts = np.concatenate([[0], np.cumsum(length)])
            doc = np.repeat(np.arange(len(pick)), length)
            n = len(flat)
            idx = []
            for k, o in enumerate(REACH):
                moved = np.full(n, -1)
                if o == 0:
                    moved = flat
                elif abs(o) < n:
                    here, there = (slice(-o, None), slice(None, o)) if o < 0 else (slice(None, -o), slice(o, None))
                    moved[here] = np.where(doc[here] == doc[there], flat[there], -1)
                f = np.where(moved[:, None] >= 0, table[moved], n_f - 1) + k * n_f
                idx.append(f)
            idx = np.concatenate(idx, axis=1)
            c = class_of_[flat]
            pidx = np.stack([(p * n_c + _shift(c, doc, a)) * n_c + _shift(c, doc, b) for p, (a, b) in enumerate(PAIRS)], 1)
            ridx = run_table[run]
            # rows that stand for nothing keep zero
            unary = w[idx].sum(1) + pw[pidx].sum(1) + rwt[ridx].sum(1)
            belief, expected = _expected(unary, starts[:-1], length, step, _blocks)
            wrong += (belief.argmax(1) != y).sum()
            total += n
            loss -= np.log(np.maximum(belief[np.arange(n), y], 1e-12)).sum()
            g = belief.copy()
            g[np.arange(n), y] -= 1
            inner = doc[1:] == doc[:-1]
            gs = expected
            np.add.at(gs, (y[:-1][inner], y[1:][inner]), -1)
            for k, (x, ix) in enumerate(((w, idx), (pw, pidx), (rwt, ridx))):
                rows, cells = np.repeat(np.arange(n), ix.shape[1]), ix.ravel()
                gx = np.stack([np.bincount(cells, weights=g[rows, j], minlength=len(x)) for j in range(N_LABELS)], 1).astype(np.float32)
                gx += DECAY * n * x
                sums[k] += gx * gx
                x -= RATE * gx / np.sqrt(sums[k])
            w[n_f - 1 :: n_f] = 0
            rwt[-1] = 0
            gs[bad] = 0
            sums[3] += gs * gs
            step -= RATE * gs / np.sqrt(sums[3])
        print(f"pass {epoch + 1}: log loss {loss / total:.5f}, wrong tokens {wrong / total:.5f}", flush=True)
    # what says next to nothing is left out
    for x in (w, pw, rwt):
        x[np.abs(x) < 0.03] = 0
    field.weights = w.reshape(len(REACH), n_f, N_LABELS)[:, :-1].transpose(1, 0, 2).copy()
    field.pairs = pw.reshape(len(PAIRS), n_c, n_c, N_LABELS)
    field.run_weights, field.step = rwt[:-1], step
    field.skip = skip_potentials(field, sample, encoded)
    return field


def _expected(unary, first, length, step, blocks):
    """Marginals of places and summed expectations of steps."""
    out, pairs = np.zeros_like(unary), np.zeros((N_LABELS, N_LABELS), np.float32)
    trans = np.exp(step)
    for pick, place, inside in blocks(first, length):
        e = unary[place]
        e = np.exp(e - e.max(2, keepdims=True))
        n = place.shape[1]
        fwd, bwd = np.empty_like(e), np.empty_like(e)
        fwd[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for t in range(1, n):
            f = (fwd[:, t - 1] @ trans) * e[:, t]
            fwd[:, t] = f / f.sum(1, keepdims=True)
        bwd[:, n - 1] = 1
        for t in range(n - 2, -1, -1):
            x = (e[:, t + 1] * bwd[:, t + 1]) @ trans.T
            bwd[:, t] = np.where(inside[:, t + 1][:, None], x / x.sum(1, keepdims=True), 1)
        p = fwd * bwd
        p /= p.sum(2, keepdims=True)
        out[place[inside]] = p[inside]
        for t in range(n - 1):
            live = inside[:, t + 1]
            q = fwd[live, t][:, :, None] * trans * (e[live, t + 1] * bwd[live, t + 1])[:, None, :]
            pairs += (q / q.sum((1, 2), keepdims=True)).sum(0)
    return out, pairs


def skip_potentials(field: Field, sample, encoded) -> np.ndarray:
    """Per kind of link and label, the log odds that a place linked to one with the label has it too rather than none.

    Other pairs of labels have no potential: a place that is surely no item says nothing about the places linked to it.
    """
    tagger = Tagger(field, Names.of([]))
    joint = np.full((2, N_LABELS, N_LABELS), 1.0)
    for (text, _), (_, y) in zip(sample, encoded):
        _, flat, _, starts = tagger.encode([text])
        pairs, kind = tagger.links(flat, starts)
        for (a, b), k in zip(pairs, kind):
            joint[k, y[a], y[b]] += 1
            joint[k, y[b], y[a]] += 1
    out = np.zeros_like(joint)
    for k in (WITH_NEIGHBOUR, ALONE):
        for label in range(1, N_LABELS):
            out[k, label, label] = np.log(joint[k, label, label] / joint[k, label, 0])
    return np.clip(out, -4, 4).astype(np.float32)


EMPTY = Field([], np.zeros((0, len(REACH), N_LABELS), np.float32), [], np.zeros((len(PAIRS), 1, 1, N_LABELS), np.float32), [], np.zeros((0, N_LABELS), np.float32), np.zeros((N_LABELS, N_LABELS), np.float32), np.zeros((2, N_LABELS, N_LABELS), np.float32))


def main(folder: str, out: str | None = None) -> None:
    import duckdb

    con = duckdb.connect()
    known = con.execute(f"select name, part_of_name from '{folder}/known_names.parquet' order by name_id").fetchall()
    texts = [r[0] for r in con.execute(f"select distinct content from '{folder}/messages.parquet' where content <> '' order by 1").fetchall()]
    random.Random(7).shuffle(texts)
    names = Names.of(known)
    plain = plain_sentences(texts[:SAMPLE], names)
    print(len(plain), "sentences without items")
    maker = Maker(11, plain, known)
    sample = [maker.text() for _ in range(SAMPLE)]
    field = fit(sample, names)
    field.save(out)
    assert len(LABELS) == N_LABELS


if __name__ == "__main__":
    main(*sys.argv[1:3])
