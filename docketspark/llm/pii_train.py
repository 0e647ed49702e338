"""Training of the semi-Markov field: python -m docketspark.llm.pii_train writes pii_weights.py.

The labelled sample is made from sentence frames with slots, in a fixed number (SAMPLE, a
documented bound) and from a fixed seed.  In a frame, {name}, {phone} ... are entities and {x...}
look-alikes that are none.  The objective is the conditional log-likelihood of the labelled
segmentation, with an L2 penalty; its gradient is observed minus expected feature counts, the
expectation by forward-backward over the lattice of candidate segments.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from pathlib import Path

from docketspark.llm.pii import Segment, best_segments, candidates, nip_ok, pesel_ok, score

SAMPLE = 9000
HELD_OUT = 600
PENALTY = 0.003
ROUNDS = 50
#: Features that grow with the sample's vocabulary; a word by itself may count against a name only, so that
#: the sample's own names are not learned by heart.
GROWING = ("name|w:", "name|end3:", "name|end2:", "name|l:", "name|r:")
NO_LISTS = ("name|w:",)
KEEP = 0.06  # weights below this are left out

#: Sentence frames of the labelled sample.
FRAMES = """
Stawił się {name}, który złożył oświadczenie.|Wniosek złożyła Pani {name} w terminie.|Sporządził mec. {sur}.
Prosimy pytać o pana {name} z działu.|Podpisano: {name}|Umowę zawarto z {surfirst} oraz świadkiem.
Dla sędziego {sur} przygotowano kopię.|Obecni: {name}, {name}.|Z poważaniem\n{name}\n|Kind regards,\n{name}.
Herr {name} war anwesend.|Frau {name} hat unterschrieben.|Mr {name} agreed to the terms.|Witness {name} was heard.
Imię i nazwisko: {name}; zawód: brak.|Osoba: {capsname}, pouczona.|Pełnomocnik, adw. {initial}, odmówił.
Radca prawny {name} wniósł apelację.|Nabył {name} wraz z żoną.|Rozmowa z prok. {sur} trwała krótko.
Numer telefonu: {phone}.|tel. {phone}|tel.: {phone} (sekretariat)|Kontakt: {phone}, po godzinie 9.|Proszę dzwonić {phone}.
Call {phone} before five.|Telefonisch erreichbar: {phone}.|Nr do biura: kom. {phone}.|Numer to {prefixed} i nic więcej.
Klient zostawił {prefixed}, prosi o oddzwonienie.|Zostawił kartkę {prefixed}|Pod numerem {dashed} nikt nie odbiera.
Pisz na {email} do piątku.|Kontakt: {email}, pilne.|Odpowiedź ({email}) wpłynęła.|Send it to {email} today.|od\t{email}\tdo nikogo
PESEL {pesel} sprawdzono.|numer ewidencyjny {pesel}|Wpisano {pesel} bez podpisu.|legitymujący się numerem {pesel}, zam.
NIP {nip} firmy.|Podatnik o NIP: {nip} złożył.|Tax number {nip}.|Steuernummer {nip}.|numer identyfikacji {nip}
Dowód osobisty {card} okazano.|seria i numer dowodu: {card}.|dow. os. {card}|Identity card {card} was shown.|Personalausweis {card} lag vor.
Paszport nr {pass} utracił ważność.|paszport {pass}|passport no. {pass}|Reisepass {pass}.
Adres: {addr}.|zam. Nowinki, {addr}.|Lokal przy {addr} w Nowinkach oddano.|{postal} Nowinki\n{addr}\n|Oględziny przy {addr} (Nowinki).
Korespondencję kierować: {bare}, {postal} Nowinki.|Adres do doręczeń: {addr}, {postal} Stare Pole.|Korespondencję kierować: {bareflat}, {postal} Nowinki.
Zustellung an {german}, 12345 Neustadt.|Notices go to {english}, Newtown.
Kwota {xmoney} zł została zapłacona.|Wartość przedmiotu sporu to {xmoney} zł.|szkoda wyniosła {xmoney} PLN.|for a total of EUR {xmoney}.
Zamówienie nr {xbadpesel} zrealizowano.|Rachunek {xaccount} zamknięto.|Rachunek nr {xaccount}.|Faktura FV/{xnum}/12 opiewa na {xmoney} euro.
Księga wieczysta ZL1Z/{xnum8}/7 jest czysta.|Numer {xbadnip} jest błędny.|pismo z dnia {xdate} r.|w dniu {xiso} strony zawarły umowę.
Wersja modułu redakcja@{xver} działa.|Przekazano do @{xhandle}, pokój 185.|zob. załącznik nr 22, k. 600 akt.|wyrok w sprawie XII CSK 624/14.|Ugoda (XX Ca 1092/10).|sygn. akt IX P 1720/22|umowa (V K {xnum}/12, zn. 0/46)|inaczej XIII GC 21/19.
Sąd Okręgowy w Nowinkach oddalił.|Sąd Rejonowy w Olszance Starej wyrokiem.|umowy z Zagrodex Sp. z o.o. zawartej.|Najwyższa Izba Handlowa orzekła.
Krajowa Rada Notarialna uznała.|Szanowny Panie Mecenasie, dziękuję.|Pani Prezes nie przyszła.|Skarb Państwa zapłaci.|Por. Art. 15 Kodeksu.
Powierzchnia lokalu wynosi 485 m², a czynsz {xmoney} PLN.|Termin wynosi 8 dni. Zn. 0/{xnum}.|Umowa Nr 15 z Wektoria S.A. trwa.|The Court Street decision.
Dz.U. z 2002 r. poz. 798, art. 639 § 2 k.c.|Wykonawca usunie wady w terminie 6 dni.|Rozdział II ust. 12 Regulaminu 2019.|Biegły z zakresu budownictwa podał.
{plain}
"""

#: More frames of the sample, with names of any origin ({any}) and capitalised phrases that are none.
NAME_FRAMES = """
{any} złożył wniosek o odroczenie.|Wniosek złożyła {any} w terminie.|W imieniu powoda działa {any}, adwokat.|Umowę podpisał {any} w dniu wczorajszym.
Strony reprezentują {any} oraz {any}.|Pismo doręczono {any} osobiście.|Powód {any} wnosi o zasądzenie.|Obecni: {any}, {any} i protokolant.|Sprawę prowadzi {any}.
Sprzedającym jest {any}, zwany dalej zbywcą.|Zeznawał {any}, lat 40.|Pan {any} nie stawił się.|Pani {any} przyszła później.|Imię i nazwisko: {any}\n|Podpisano: {any}
Rozmawiałem z {any} o terminie.|Nieruchomość kupił {any} wraz z żoną.|świadek {any} potwierdził|Do wiadomości: {any}.|Z poważaniem,\n{any}\n
{any} appeared before the court.|The contract was signed by {any} on Monday.|Mr {any} replied.|Mrs {any} called.|According to {any}, the goods arrived.|Regards,\n{any}
I spoke to {any} about it.|The witness {any} was heard.|Counsel for the buyer is {any}.|Herr {any} war anwesend.|Frau {any} erklärte sich bereit.|Der Zeuge {any} sagte aus.
Der Vertrag wurde von {any} unterschrieben.|Geschäftsführer ist {any}.|Mit freundlichen Grüßen\n{any}|Свідок {cyr} пояснив обставини.|Позивач {cyr} подав заяву.|Договір підписав {cyr} учора.
З повагою,\n{cyr}|Директор {cyr} погодився.|Herr {anysur} fragte nach.|Mr {anysur} left.|Pan {anysur} zapytał.|mec. {anysur} odpisał.|Dr {anysur} operierte.
Z poważaniem\n{name}\n Najemca odmówił.|Z poważaniem\n{name}\n Termin minął.|Pozdrawiam\n{name}\n Dnia 5 maja strony|Z poważaniem\n{any}\n Lokal oddano.|Z szacunkiem\n{name}\nOdpis otrzymują|Z poważaniem\n{name}\n Nr 15 z akt|Kind regards\n{any}\n Please reply.|Z poważaniem\n{name}\n Wykonawca zszedł.|Z poważaniem\n{name}\n {xinst} oddalił skargę.|Podpis\n{name}\nUmowa wygasła.|{any}\nPozwany milczy.|Z wyrazami szacunku\n{any}\n Organ odmówił.|Regards\n{any}\n The buyer paid.|{xhandle2}\n\n{xinst} oddalił.|{xhandle2}\nThe tenant left.|{xhandle2}
Korespondencję kierować: {nbare}, {postal} Nowinki.|Korespondencję kierować: {nbare}, {postal} Stare Pole.|Adres do doręczeń: {nbare}, {postal} Nowinki.|kierować na {nbare}, {postal} Olszanka.|Korespondencję kierować: {nbare}, {postal} Wrzosy. Dalej nic.
Wczoraj {any} oddał klucze.|Nabywca {any} zapłacił cenę.|Dłużnik {any} nie odpowiada.|Sprzedawca {any} potwierdza odbiór.|Dzisiaj {any} wyjechał.|Wykonawca {any} zszedł z placu.|Najemca {any} opuścił lokal.|Rok temu {any} kupiła dom.
Today {any} moved out.|Later {any} sold the car.|Buyer {any} refuses.|Tenant {any} pays rent.|Heute hat {any} bezahlt.|Danach ging {any} nach Hause.|Mieterin {any} zog aus.|Покупець {cyr} відмовився.|Сьогодні {cyr} виїхав.|Адвокат {cyr} подав скаргу.|Заява, яку написала {cyr}, втрачена.
Dom należy do {any} od lat.|Zaświadczenie dla {any} wydano.|Klucze ma {any}.|Opinię sporządził {any}, inżynier.|Spadek nabyła {any} w całości.|Autem kierowała {any} z Krakowa.|Zgłosił się {any} i podpisał.|Opiekunem jest {any}, a matka wyjechała.|{any} mieszka obok.|{any} nie zgadza się z wyrokiem.
{any} prosi o odpis.|{any} żąda zwrotu.|{any} i jego żona|{any} (ur. 1970)|{any} - najemca|{any} was late.|{any} has agreed.|{any} does not reply.|{any} signed it.|{any} wants a refund.|{any} ist krank.|{any} hat gekündigt.|{any} wohnt hier.|{any} bat um Aufschub.|{cyr} живе тут.|{cyr} не погоджується.
A letter from {any} arrived.|It was {any} who paid.|We thank {any} for help.|Der Brief von {any} kam an.|Es war {any}, der zahlte.|Mit {any} wurde gesprochen.|Лист від {cyr} надійшов.|Pani {anysur} odmówiła.|Frau {anysur} lachte.|Mrs {anysur} agreed.|sędzia {anysur} orzekł|prof. {anysur} napisał
{xinst} prosi o odpis.|{xinst} nie zgadza się.|{xinst} żąda zwrotu.|Opinię sporządził {xinst}.|Dom należy do {xcompany} od lat.|Klucze ma {xinst}.|{xcompany} nie odpowiada.|Wczoraj {xinst} wydał decyzję.|Dzisiaj {xcompany} ogłosiła upadłość.|Later the {xenglish} was read.|{xenglish} was late.
Heute hat das {xgerman} entschieden.|Mit dem {xgerman} wurde gesprochen.|Лист від {xukr} надійшов.|{xukr} не погоджується.|Z {xlaw} wynika obowiązek.|Dojazd z {xplace} trwa godzinę.|{xplace} leży nad rzeką.|W {xplace} spadł śnieg.|Sprawa {xcode} trwa.|Zob. {xcode} oraz {xcode}.|{xhead}
{xinst} złożył wniosek o odroczenie.|W imieniu powoda działa {xinst}.|Umowę podpisał {xinst} w dniu wczorajszym.|Pismo doręczono: {xinst}.|Sprawę prowadzi {xinst}.|{xinst} oddalił powództwo.
Zgodnie z art. 5 {xlaw} termin biegnie.|Na podstawie {xlaw} orzeczono.|{xlaw} stanowi inaczej.|{xhead}\n|{xhead}: zapłata|Mieszka w miejscowości {xplace} od roku.|Droga do {xplace} jest zamknięta.|Urząd w {xplace} odmówił.
{xcompany} złożyła ofertę.|Umowę z {xcompany} rozwiązano.|Oferta {xcompany} jest najtańsza.|Sygn. {xcode} umorzono.|wyrok w sprawie {xcode} jest prawomocny|({xcode})|Wyrok {xcode}. Dalej.
{xenglish} replied late.|The {xenglish} shall apply.|Under the {xenglish} the buyer pays.|This {xenglish} was signed by the parties.|According to the {xenglish}, payment is due.|{xgerman} wurde vertagt.|Das {xgerman} wies ab.|Das {xgerman} sagte aus.
Beim {xgerman} wurde geklagt.|Laut {xgerman} ist die Frist abgelaufen.|{xukr} пояснив обставини.|Відповідно до {xukr} строк спливає.|Nadawca {xinst} wysłał|Dokument {xhandle2} przyjęto.
"""

#: Frames that are kept out of training, for the held-out figures.
HELD_FRAMES = """
Odbiór potwierdziła {any}.|Lokal wynajmuje {any} od stycznia.|Jak zeznał {any}, auto stało na parkingu.|Pełnomocnikiem jest {any}.|Pismo przygotowała {any}, referent.|Pożyczkobiorca {any} spłacił dług.
{any} nie wniosła sprzeciwu.|Przekazano sprawę, którą zajmie się {any}.|Yesterday {any} met the seller.|The claimant, {any}, lives abroad.|Signed: {any}\n|Ms {any} disagreed.|The notice was sent to {any} by post.
Gestern kam {any} ins Büro.|Frau {any} kündigte.|Herr {any} zahlte nicht.|Unterschrieben von {any}.|Пан {cyr} підписав договір.|Заяву подала {cyr} особисто.|Відповідач {cyr} заперечує.|Pan {anysur} zadzwonił.|Mrs {anysur} wrote.
{xinst} nie wniósł sprzeciwu.|Odbiór potwierdził {xinst}.|Lokal wynajmuje {xcompany} od stycznia.|Jak wynika z {xlaw}, termin minął.|Wyrok wydał {xinst} w składzie.|Yesterday the {xenglish} ended.|The notice under the {xenglish} was sent.
Gestern verkündete das {xgerman} den Beschluss.|Der Streit vor dem {xgerman} ist beendet.|Згідно з {xukr} це дозволено.|Wyjazd do {xplace} odwołano.|Akta {xcode} zwrócono.|{xhead}\n
"""

#: Names of the sample, and others that only the held-out texts have (most are on no list of the field).
ANY_GIVEN = "Hans Klaus Petra Sabine Wolfgang John Mary David Emma James Linda Oleksandr Olena Iryna Mykola Ahmed Fatima José Carlos Giulia Pierre Chloé Nguyen Lukas Dmytro Bjørn Karol Anna Marek Ewa Zofia Igor Svitlana Pavel Zuzana".split()
ANY_SUR = "Müller Schmidt Weber Becker Hoffmann Schulz Smith Jones Brown Taylor O’Neill Wilson Kovalenko Bondarenko Melnyk Nowak Wójcik Kowalczyk Mazur Krawczyk Zając Wrona Sikora García Rossi Dubois Hassan Khan Andersen Novák Lis Duda Kozak Petrenko Hughes Richter".split()
CYR_GIVEN = "Олександр Ірина Микола Олена Іван Наталія Сергій Юлія Петро Світлана".split()
CYR_SUR = "Шевченко Коваленко Мельник Ткачук Бондаренко Іваненко Олійник Савчук Руденко Гончар".split()
HELD_GIVEN = "Dieter Gisela Mia Friedrich Oskar Michael Sarah Grace Oliver Kateryna Bohdan Yusuf Aisha Luca Émile Ivana Tomáš Nadia Ravi Ingeborg Halyna Vasyl Seán Henrik Mateo Bogusław Iwona".split()
HELD_SUR = "Fischer Wagner Schäfer Koch Johnson Williams Evans Clark Tymoshenko Lysenko Baran Dudek Pawlak Gajda Kubiak Bianchi Moreau Haddad Svoboda Larsen Patel Kravets Mroczek Wilk Król McCarthy D’Angelo Braun".split()
HELD_CYR = ("Тарас Оксана Андрій Людмила Богдан Галина".split(), "Кравчук Поліщук Лисенко Ткаченко Мороз Білик".split())

#: What capitalised phrases that are no names are made of; the halves after the bar are for the held-out texts.
NOUNS = """
inst: Sąd Izba Rada Urząd Ministerstwo Wydział Komisja Fundacja Stowarzyszenie Uniwersytet Bank Zakład Kancelaria Rzecznik Prokuratura Biuro Zarząd Instytut Trybunał | Agencja Inspektorat Związek Starostwo Centrum Zespół Skarb
adj: Okręgowy Rejonowy Apelacyjny Najwyższy Cywilny Handlowa Krajowa Główny Europejska Narodowy Gospodarczy Miejski Gminny Powiatowa Wojewódzki Administracyjny Adwokacka Notarialna Skarbowy Państwowa | Karny Rodzinny Społecznych Lekarska Regionalny Polska
law: Kodeksu Ustawy Konstytucji Rozporządzenia Regulaminu Statutu Umowy Kodeks Ustawa Dziennika | Prawa Dyrektywy Traktatu
lawadj: Cywilnego Karnego Pracy Ustaw Rodzinnego Handlowych Najmu Głównej Spółki Rzeczypospolitej Administracyjnego | Morskiego Podatkowego Budowlanego
place: Olszanka Wola Huta Dąbrowa Górka Kamienica Brzeziny Lipnica Wilkowice Zalesie Cegielnia Wieś | Kuźnia Polana Rzeka Osada
placeadj: Nowa Stara Wielka Mała Górna Dolna Nowej Starej Wielkiej Górnym Dolnej Leśna | Zielona Piękna Cicha Dolny
english: Supreme High Civil Service Supply Lease Share Purchase Data General Board Executive Annual Works Framework Building Final | Loan Interim Trade Credit Labour
englishnoun: Court Agreement Act Code Party Parties Schedule Annex Directors Committee Contract Notice Terms Meeting Order Report Fund | Deed Policy Statement Union
german: Amtsgericht Landgericht Finanzamt Versicherung Gesellschaft Vertrag Urteil Klage Kündigung Bürgerliches Grundbuch Standesamt Jugendamt | Oberlandesgericht Arbeitsgericht Handelsregister Bauamt
germannoun: Neustadt Gesetzbuch Mitte Nord Altdorf Musterstadt Bergheim Leipzig Köln | Steinfeld Hamburg Süd
ukr: Верховний Цивільний Окружний Апеляційний Міський Кримінальний Господарський | Районний Сімейний
ukrnoun: Суд Кодекс Рада Закон Договір Комітет Банк | Палата Статут
head: POZEW WYROK WNIOSEK UMOWA PEŁNOMOCNICTWO ZAŁĄCZNIK PROTOKÓŁ OŚWIADCZENIE UZASADNIENIE POSTANOWIENIE AGREEMENT VERTRAG | APELACJA ANEKS ZAŻALENIE
headnoun: ZAPŁATY NAJMU SPRZEDAŻY OGÓLNE KOŃCOWE STRON PROCESOWE ROZPRAWY DOSTAWY POWODA GENERAL | DZIERŻAWY WSTĘPNE POZWANEGO
company: Zagr Hydro Stal Agro Meblo Korbo Trakt Papir Lumi Wekt Kwarc | Beto Drewno Termo
companyend: ex mix pol bud trans sfera tex ia on met | plast eko lux
form: Sp. z o.o.|S.A.|Sp. k.|GmbH|Ltd|Sp. j.|AG
code: CSK ACa GC Ns FSK RC Ca Co CZP UZP OSK SA KIO Pa | GSK Cz AKa
"""


def _bank() -> dict[str, tuple[list[str], list[str]]]:
    out = {}
    for line in NOUNS.strip().split("\n"):
        key, _, rest = line.partition(": ")
        if key == "form":
            out[key] = (rest.split("|"),) * 2
        else:
            a, _, b = rest.partition(" | ")
            out[key] = (a.split(), b.split() or a.split())
    return out


_BANK = _bank()


def _phrase(r: random.Random, slot: str, held: bool) -> str:
    """A capitalised phrase that names nobody."""

    def w(key: str) -> str:
        return r.choice(_BANK[key][held])

    company = f"{w('company')}{w('companyend')}"
    return {
        "xinst": r.choice([f"{w('inst')} {w('adj')}", f"{w('adj')} {w('inst')}", f"{w('inst')} {w('adj')} {w('adj')}"]),
        "xlaw": f"{w('law')} {w('lawadj')}",
        "xplace": r.choice([f"{w('place')} {w('placeadj')}", f"{w('placeadj')} {w('place')}"]),
        "xcompany": r.choice([f"{company} {w('form')}", f"{company} {company[:4]} {w('form')}", f"{w('company')}{w('companyend')} {w('form')}"]),
        "xcode": f"{r.choice(['I', 'II', 'III', 'IV', 'VI', 'IX', 'XI', 'XX'])} {w('code')} {r.randrange(1, 2000)}/{r.randrange(10, 25)}",
        "xenglish": r.choice([f"{w('english')} {w('englishnoun')}", f"{w('english')} {w('english')} {w('englishnoun')}"]),
        "xgerman": r.choice([f"{w('german')} {w('germannoun')}", f"{w('german')} {w('germannoun')}-{w('germannoun')}"]),
        "xukr": f"{w('ukr')} {w('ukrnoun')}",
        "xhead": r.choice([f"{w('head')} {w('headnoun')}", f"{w('head')} O {w('headnoun')}", f"{w('head')} {w('headnoun')} {w('headnoun')}"]),
        "xhandle2": "".join(r.choice("abcdeXYZTQ0123456789") for _ in range(9)).capitalize() + " " + r.choice(["The", "Por", "Dok"]),
    }[slot]


def _made_up(r: random.Random) -> str:
    """A surname that is on no list, from syllables."""
    return "".join(r.choice(["ba", "ko", "ri", "mo", "ste", "lan", "hu", "ver", "da", "ni", "gro", "tu", "sza", "bel"]) for _ in range(r.randrange(1, 3))).capitalize() + r.choice(["n", "k", "rt", "s", "wicz", "man", "er", "sen", "ini", "ov", "ak", "uk", "ek"])


def _any(r: random.Random, slot: str, held: bool) -> str:
    """A name of any origin; a held-out one is made of names the sample does not have."""
    if slot == "cyr":
        given, sur = HELD_CYR if held else (CYR_GIVEN, CYR_SUR)
    else:
        given, sur = (HELD_GIVEN, HELD_SUR) if held else (ANY_GIVEN, ANY_SUR)
    g, s = r.choice(given), r.choice(sur)
    if slot == "any" and not held and r.random() < 0.5:
        s = _made_up(r)
        g = _made_up(r) if r.random() < 0.4 else g
    if slot == "anysur":
        return s
    return r.choice([f"{g} {s}"] * 8 + [f"{s} {g}", f"{g[0]}. {s}", f"{g} {s}-{r.choice(sur)}", f"{g}\n{s}", f"{g} {r.choice(given)} {s}"])


#: Parts that fill the slots; surnames are put together from them.
STEMS = "Kowal Nowak Zieleń Wiśniew Dąbrow Brzozow Kalin Jabłoń Ostrow Wrób Kamień Górec Lipiń Sosnow".split()
STREETS = "Polna Leśna Krótka Ogrodowa Słoneczna Długa|Nowy Świat|Stary Rynek|Nad Wisłą|Trzech Krzyży|Jana Matejki|3 Maja|Wojska Polskiego".split("|")
WORDS = "umowa została rozwiązana przed terminem zapłata nastąpiła wczoraj strony ustaliły nowe warunki dostawy towaru".split()


def _digits(r: random.Random, n: int) -> str:
    return str(r.randrange(1, 10)) + "".join(str(r.randrange(10)) for _ in range(n - 1))


def _until(r: random.Random, n: int, ok) -> str:
    while not ok(d := _digits(r, n)):
        pass
    return d


def _surname(r: random.Random, case: int, fem: bool) -> str:
    stem = r.choice(STEMS) + r.choice(["sk", "iń" "sk", "ow" "sk"])
    s = stem + (["a", "iej"] if fem else ["i", "iego"])[case]
    return s + "-" + r.choice(STEMS) + "ow" + "sk" + (["a", "iej"] if fem else ["i", "iego"])[case] if r.random() < 0.12 else s


def _fill(r: random.Random, slot: str, held: bool = False) -> str:
    if slot in ("any", "anysur", "cyr"):
        return _any(r, slot, held)
    if slot in ("xinst", "xlaw", "xplace", "xcompany", "xcode", "xenglish", "xgerman", "xukr", "xhead", "xhandle2"):
        return _phrase(r, slot, held)
    gap = r.choice([" "] * 8 + ["\n", "  "])
    if slot in ("name", "surfirst", "capsname", "sur", "initial"):
        fem, case = r.random() < 0.5, r.random() < 0.35
        given = r.choice("Adam Marcin Jerzy Robert Jan".split() if not fem else "Anna Ewa Dorota Teresa Maria Irena".split())
        if case:
            given = {"Jerzy": "Jerzego", "Maria": "Marii"}.get(given, given[:-1] + "y" if fem else given + "a")
        sur = _surname(r, case, fem)
        s = {"name": given + gap + sur, "surfirst": sur + gap + given, "capsname": (sur + gap + given).upper(), "sur": sur, "initial": f"{given[0]}. {sur}"}
        return s[slot]
    if slot in ("phone", "prefixed", "dashed"):
        d = _digits(r, 9)
        a, b, c = d[:3], d[3:6], d[6:]
        forms = [f"{a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", d, f"({d[:2]}) {d[2:5]} {d[5:7]} {d[7:]}", f"{d[:2]} {d[2:5]}-{d[5:7]}-{d[7:]}", f"{a}\xa0{b}\xa0{c}"]
        pre = [f"+48 {a} {b} {c}", f"+48{d}", f"(+48) {a} {b} {c}", f"0048 {a} {b} {c}", f"+48-{a}-{b}-{c}"]
        return r.choice(pre if slot == "prefixed" else [f"{a}-{b}-{c}", forms[5]] if slot == "dashed" else forms + pre)
    if slot == "email":
        local = r.choice(["jan.nowak", "biuro_kowal", "ewa51", "a.wisniewska+sprawa3", "JAN.NOWAK"])
        domain = r.choice([["poczta", "test"], ["firma-x", "example"], ["dzial", "firma", "example"]])
        at, dot = r.choice([("@", ".")] * 4 + [(" [at] ", " [dot] "), ("(at)", "."), (" (at) ", "."), (" [at] ", ".")])
        s = local + at + dot.join(domain)
        return r.choice(["", "", "mailto:", "<"]) + "\x01" + s + "\x02"
    if slot == "pesel":
        d = _until(r, 11, pesel_ok)
        return r.choice([d, f"{d[:6]} {d[6:]}", f"{d[:6]}-{d[6:]}", f"{d[:2]} {d[2:4]} {d[4:6]} {d[6:]}"])
    if slot == "nip":
        d = _until(r, 10, nip_ok)
        return r.choice([d, "PL" + d, f"{d[:3]}-{d[3:6]}-{d[6:8]}-{d[8:]}", f"{d[:3]}-{d[3:5]}-{d[5:7]}-{d[7:]}", f"{d[:3]} {d[3:6]} {d[6:8]} {d[8:]}"])
    if slot in ("card", "pass"):
        s = "".join(r.choice("ABCDEFGHKLMPRSTWXYZ") for _ in range(3 if slot == "card" else 2))
        d = _digits(r, 6 if slot == "card" else 7)
        if slot == "card":
            return r.choice([s + d, f"{s} {d}", f"{s}-{d}", f"{s} {d[:3]} {d[3:]}", s.lower() + d])
        return r.choice([s + d, f"{s} {d}", f"{s}-{d}"])
    number = str(r.randrange(1, 200)) + r.choice(["", "", "a", "C"])
    street = r.choice(r.choice(STREETS).split() if r.random() < 0.1 else STREETS)
    street = r.choice(street.split()) if street.startswith("Polna") else street
    flat = r.choice(["", f"/{r.randrange(1, 60)}", f" m. {r.randrange(1, 60)}", f" lok. {r.randrange(1, 60)}"])
    if slot == "addr":
        return r.choice(["ul. ", "Ul. ", "al. ", "pl. ", "os. ", "ulica ", "ulicy ", "ul.\n"]) + f"{street} {number}{flat}"
    if slot == "bare":
        return f"{street} {number}" if not street[0].isdigit() else f"Polna {number}"
    if slot == "nbare":  # a street named after a person
        fem = r.random() < 0.5
        return f"{r.choice(['Anny', 'Marii', 'Ewy', 'Zofii'] if fem else ['Jana', 'Adama', 'Karola', 'Marcina'])} {_surname(r, 1, fem)} {number}{flat or ' m. 3'}"
    if slot == "bareflat":
        return f"{r.choice(['Polna', 'Leśna', 'Nad Wisłą', 'Jana Matejki'])} {number}{flat or '/5'}"
    if slot == "german":
        return r.choice(["Hauptstraße", "Gartenweg", "Marktgasse", "Am Brunnen"]) + f" {number}"
    if slot == "english":
        return f"{number} " + r.choice(["High Street", "Green Lane", "Old Mill Road", "Park Avenue"])
    big = f"{r.randrange(1, 999)}", f"{r.randrange(1000):03d}", f"{r.randrange(1000):03d}"
    return {
        "postal": f"{r.randrange(10, 99)}-{r.randrange(100, 999)}",
        "xmoney": r.choice([" ", ".", "\xa0"]).join(big[: r.choice([2, 3])]) + r.choice(["", ",00", ",27"]),
        "xbadpesel": _until(r, 11, lambda d: not pesel_ok(d)),
        "xbadnip": _until(r, 10, lambda d: not nip_ok(d)),
        "xaccount": _digits(r, 2) + "".join(" " + _digits(r, 4) for _ in range(6)),
        "xnum": _digits(r, 4),
        "xnum8": _digits(r, 8),
        "xdate": f"{r.randrange(10, 28)}.{r.randrange(10, 12)}.{r.randrange(2000, 2024)}",
        "xiso": f"{r.randrange(2000, 2024)}-{r.randrange(10, 12)}-{r.randrange(10, 28)}",
        "xver": f"{r.randrange(1, 9)}.{r.randrange(1, 30)}",
        "xhandle": r.choice(["zespol-x", "recepcja"]),
        "plain": " ".join(r.sample(WORDS, 6)).capitalize() + ".",
    }[slot]


KINDS = {"any": "name", "anysur": "name", "cyr": "name", "name": "name", "surfirst": "name", "capsname": "name", "sur": "name", "initial": "name", "phone": "phone", "prefixed": "phone", "dashed": "phone", "email": "email", "pesel": "identity", "nip": "identity", "card": "identity", "pass": "identity", "addr": "address", "bare": "address", "bareflat": "address", "nbare": "address", "german": "address", "english": "address"}


def sample(n: int, seed: int, source: str = FRAMES + NAME_FRAMES, held: bool = False) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts of one to three frames with their labelled spans (start, end, kind)."""
    r = random.Random(seed)
    frames = [f.replace("\\n", "\n").replace("\\t", "\t") for line in source.split("\n") if line for f in line.split("|")]
    out = []
    for _ in range(n):
        text, gold = "", []
        for frame in r.choices(frames, k=r.randrange(1, 4)):
            text += " " if text and not text.endswith("\n") else ""
            at = 0
            for m in re.finditer(r"\{(\w+)\}", frame):
                text += frame[at : m.start()]
                at, filled, kind = m.end(), _fill(r, m.group(1), held), KINDS.get(m.group(1))
                start = len(text)
                if "\x01" in filled:
                    start += filled.index("\x01")
                    filled = filled.replace("\x01", "").replace("\x02", "")
                text += filled
                if kind:
                    gold.append((start, len(text), kind))
            text += frame[at:]
        out.append((text, gold))
    return out


def label(text: str, gold: list[tuple[int, int, str]]) -> tuple[list[Segment], list[bool]]:
    """Candidates, and which of them are the labelled segmentation.

    A candidate stands for a label of its kind if it starts and ends where the label does, or, for an
    address, covers it (the placeholder also takes the flat, postal code and town); one each.
    """
    found = candidates(text)
    right = [False] * len(found)
    for start, end, kind in gold:
        fit = [k for k, s in enumerate(found) if s.kind == kind and s.start == start and (s.end == end or kind == "address" and s.end >= end)]
        if fit:
            right[max(fit, key=lambda k: found[k].end)] = True
    return found, right


def expectation(found: list[Segment], w: dict[str, float]) -> tuple[float, list[float]]:
    """Log-partition over all sets of non-overlapping candidates, and the candidates' marginals."""
    points = sorted({p for c in found for p in (c.start, c.end)})
    a = dict.fromkeys(points, 0.0)
    by_end: dict[int, list[int]] = defaultdict(list)
    by_start: dict[int, list[int]] = defaultdict(list)
    for k, s in enumerate(found):
        by_end[s.end].append(k)
        by_start[s.start].append(k)

    def logsum(xs: list[float]) -> float:
        m = max(xs)
        return m + math.log(sum(math.exp(x - m) for x in xs))

    s = [score(c, w) for c in found]
    last = 0.0
    for p in points:
        a[p] = last = logsum([last, *(a[found[k].start] + s[k] for k in by_end[p])])
    b, last_b = {}, 0.0
    for p in reversed(points):
        b[p] = last_b = logsum([last_b, *(b[found[k].end] + s[k] for k in by_start[p])])
    return last, [math.exp(a[c.start] + s[k] + b[c.end] - last) for k, c in enumerate(found)]


def train(data: list[tuple[str, list]], rounds: int = ROUNDS) -> dict[str, float]:
    rows = [label(t, g) for t, g in data]
    rows = [x for x in rows if x[0]]
    w: dict[str, float] = defaultdict(float)
    square: dict[str, float] = defaultdict(float)
    for _ in range(rounds):
        g: dict[str, float] = defaultdict(float)
        for found, right in rows:
            _, p = expectation(found, w)
            for c, yes, q in zip(found, right, p):
                if abs(yes - q) > 1e-4:
                    for f in c.features:
                        g[f"{c.kind}|{f}"] += yes - q
        for k, v in g.items():
            v -= PENALTY * len(rows) * w[k] * (1.0 if k.startswith(GROWING) else 0.05)
            square[k] += v * v
            w[k] += 0.6 * v / math.sqrt(square[k] + 1e-9)
            if k.startswith(NO_LISTS):
                w[k] = min(w[k], 0.0)
    return dict(w)


def held_out(w: dict[str, float], seed: int = 77, texts: list | None = None) -> tuple[float, float]:
    """Precision and recall of exact segments on texts the training has not seen, of the same frames."""
    hit = got = want = 0
    for t, gold in sample(HELD_OUT, seed) if texts is None else texts:
        found, right = label(t, gold)
        for c in found:
            c.score = score(c, w)
        chosen = best_segments(found)
        good = {(c.start, c.end, c.kind) for c, yes in zip(found, right) if yes}
        hit += sum((c.start, c.end, c.kind) in good for c in chosen)
        got += len(chosen)
        want += len(gold)
    return hit / max(got, 1), hit / max(want, 1)


def held_out_names(w: dict[str, float], seed: int = 78) -> tuple[float, float]:
    """The same on frames, names and other phrases of which training has seen none."""
    return held_out(w, texts=sample(HELD_OUT, seed, HELD_FRAMES, True))


def main() -> None:
    w = train(sample(SAMPLE, 11))
    w = {k: v for k, v in w.items() if abs(v) >= KEEP}
    body = "\n".join(f"    {k!r}: {v:.3f}," for k, v in sorted(w.items()))
    path = Path(__file__).with_name("pii_weights.py")
    path.write_text(f'"""Weights of the semi-Markov field, written by pii_train."""\n\nWEIGHTS: dict[str, float] = {{\n{body}\n}}\n')
    print(len(w), "weights; held out precision and recall:", held_out(w), "other frames and names:", held_out_names(w))


if __name__ == "__main__":
    main()
