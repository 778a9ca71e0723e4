"""The small labelled table from which the tagger is trained.

A row is a text with marks ``‹TYPE:span›``. Rows are sentence frames with slots, filled by a seeded
generator from frequent names of many countries, ordinary street words and invented words. Frames
and lists are general writing about customers and payments; they are kept apart from the texts that
are tagged, and every second name, street and town is invented, so that shape and context decide.
"""

from __future__ import annotations

import random
import re
import unicodedata

# Frequent given and family names of many countries, street words and forms of address.
GIVEN = """Liam Olivia Noah Emma James Mary Robert Linda Michael Susan William Karen Richard Nancy Daniel Betty Steven Helen Brian Deborah
Hans Ursula Werner Monika Günther Renate Stefan Birgit Andreas Heike Torsten Silke Matthias Antje Jean Marie Pierre Monique Michel Sylvie
Philippe Isabelle François Véronique Guillaume Aurélie Antonio Carmen Manuel Josefa Francisco Dolores Javier Rosario Álvaro Inés Giovanni
Francesca Giuseppe Chiara Luigi Paola João Fernanda Rui Teresa Wojciech Agnieszka Krzysztof Małgorzata Ivan Olga Sergei Tatiana Mehmet
Ayşe Mustafa Fatma Ahmed Aisha Mohammed Khadija Hassan Zainab Rajesh Priya Sanjay Anjali Amit Sunita Wei Fang Li Hiroshi Yuki
Kenji Sakura Min-jun Seo-yeon Chidi Ngozi Kwame Abena Thabo Lerato Erik Astrid Lars Kirsten Anders Karin Mikael Päivi Janne Sanna
Dimitris Eleni Giorgos Sofia Dragan Jelena Zoltán Ildikó Jiří Lenka Radu Ioana Sean Aoife Patrick Siobhán Rhys Carys Hamish Isla Kelly
Jack Amy Frank Ruth Alan Jill Neil Judy Roger Gail Kurt Ines Uwe Gabi Faith Joy Dawn Robin Sandy Drew Melody Daisy Ivy Iris Ruby Pearl Amber Victor Guy Lance Clay
Glen Summer Violet Lily Hunter Mason Parker Jasper Earl""".split()
FAMILY = """Smith Johnson Brown Taylor Wilson Davies Evans Thomas Roberts Walker Wright Robinson Thompson Hughes Edwards Hall Wood
Jackson Clarke Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder
Neumann Zimmermann Krüger Martin Bernard Dubois Moreau Laurent Lefebvre Michel Garcia Roux Fournier Girard Bonnet Mercier Blanc Guérin
Boyer García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Ruiz Hernández Díaz Moreno Muñoz Álvarez Romero Alonso Rossi
Russo Ferrari Esposito Bianchi Romano Colombo Ricci Marino Silva Santos Ferreira Pereira Oliveira Costa Carvalho Kowalski Nowak Wiśniewski
Wójcik Lewandowski Novák Svoboda Horvat Kovač Nagy Szabó Popescu Ionescu Papadopoulos Nikolaidis Ivanov Petrov Smirnov Kuznetsova Yılmaz
Kaya Demir Çelik Khan Hussain Ahmed Ali Sharma Patel Singh Gupta Kumar Reddy Wang Zhang Chen Liu Tanaka Suzuki Sato Yamamoto Kim Park Choi
Nguyen Tran Okafor Adeyemi Mensah Dlamini Nkosi Hansen Johansen Olsen Larsen Andersson Karlsson Nilsson Korhonen Virtanen Murphy Byrne
Walsh McCarthy MacDonald Campbell Jones Baker Cook Bishop Banks Stone Fields Young Long White King Page Price Day""".split()
PARTICLES = ["de ", "de la ", "van ", "van der ", "van den ", "von ", "di ", "da ", "al-", "al ", "El ", "Le ", "O'", "D'", "Mac", "Mc", "Fitz"]
FORMS = ["Mr.", "Mrs.", "Ms.", "Mr", "Mrs", "Ms", "Miss", "Dr.", "Dr", "Prof.", "Frau", "Herr", "Herrn", "Mme", "Mlle", "Sra.", "Sr.", "Señor", "Señora", "Don", "Doña", "Sir"]
FORM_SHARE = 0.18
ORG_WORDS = "Holdings Logistics Systems Trading Services Insurance Partners Capital Group Energy Foods Motors Telecom Pharma Media Software Consulting Airlines Shipping Textiles Mining Solar Group Industries".split()
LEGAL = ["Ltd", "Ltd.", "LLC", "LLP", "Inc", "Inc.", "Corp", "plc", "PLC", "GmbH", "AG", "KG", "SE", "SARL", "S.A.", "SA", "SAS", "S.L.", "BV", "N.V.", "AB", "Oy", "SpA", "Pty Ltd", "& Co", "& Sons"]
TOWNS = ["Norwich", "Leipzig", "Grenoble", "Zaragoza", "Plymouth", "Augsburg", "Saint-Étienne", "Vitoria", "Cork", "Kassel", "Aix-en-Provence", "Port Talbot", "Great Yarmouth", "Bad Homburg", "San Sebastián", "Den Haag", "New Haven", "Santa Rosa", "Fort Worth", "La Rochelle"]
# Words that place names begin with.
TOWN_HEADS = "port new san santa saint fort bad great den la le los upper lower north south east west mount lake st ober nieder villa".split()
TOWN_PARTS = ["Port {}", "New {}", "Saint-{}", "Bad {}", "Ober{l}", "Nieder-{}", "{}-sur-Mer", "Villa{l}", "{}burg", "{}ville", "{}ton", "{}dorf", "San {}", "Great {}", "{} Bay", "{}"]
EN_STREETS = ["Maple", "Victoria", "Church", "King's", "Station", "Mill Brook", "Oak", "Queen's", "Abbey", "Windsor", "Highfield", "Park View", "Cedar", "Washington", "Long Acre", "Bishop's", "Chestnut Hill", "St. Andrew's", "Lower Meadow", "Oxford", "High", "Two Mile", "Garden", "Fifth"]
EN_KINDS = ["Street", "St", "St.", "Road", "Rd", "Rd.", "Avenue", "Ave", "Ave.", "Lane", "Ln", "Ln.", "Drive", "Dr", "Court", "Ct", "Way", "Row", "Terrace", "Close", "Crescent", "Place", "Boulevard", "Blvd", "Blvd."]
DE_STREETS = ["Haupt", "Bahnhof", "Garten", "Schul", "Berg", "Kirch", "Wald", "Mozart", "Goethe", "Industrie", "Birken", "Feld", "Wiesen"]
DE_KINDS = ["straße", "strasse", "str.", "weg", "platz", "gasse", "allee", "damm", "ufer", "ring"]
FR_STREETS = ["de la République", "du Général Leclerc", "des Lilas", "de l'Église", "du Port", "Victor-Hugo", "des Écoles", "de la Gare", "du Château", "de Verdun", "des Rosiers", "de l'Hôpital"]
FR_KINDS = ["rue", "avenue", "boulevard", "chemin", "impasse", "allée", "place", "quai"]
ES_STREETS = ["del Sol", "de la Paz", "de los Reyes", "de la Luna", "de la Iglesia", "del Prado", "de las Flores", "de la Constitución"]
ES_KINDS = ["Calle", "C/", "Avenida", "Avda.", "Plaza", "Paseo", "Camino"]
TOPICS = ["exchange rate", "bank holiday", "standing order", "invoice total", "card limit", "interest", "currency code", "daily import", "opening balance", "mandate", "chargeback", "rent", "pension", "subscription", "insurance claim", "tax year", "delivery", "monthly statement", "price list", "parking fee", "input file", "time stamp", "commission", "batch run"]
INVENTED = 0.5  # share of names, towns and streets that are put together at random instead of taken from the lists
ONSETS = "B Br C Ch D Dr F Fl G Gr H J K Kl L M N P Pr R S Sch Sh St T Th Tr V W Y Z".split()
VOWELS = "a e i o u ai ei ie ou é ö".split()
CODAS = "l ll m n nn r rd rt s ss ck ng nd tt lv rv x st mp lk".split()
LASTS = "a e o y i n r s l son man er ic ez i ley ton berg ard in us et uk ov as".split() + [v + c for v in "aeiou" for c in "rt lt nd rn x ck st p m th lm g b re ro na li".split()]
LABELS_ID = {
    "ssn": ["SSN", "SSN", "Social Security", "social security", "Soc. Sec.", "SS"],
    "ni": ["NI", "NINO", "National Insurance", "nat. ins."],
    "nir": ["NIR", "INSEE", "numéro de sécurité sociale", "sécu"],
    "tax": ["tax", "tax ID", "Steuer-ID", "Steuernummer", "TIN", "numéro fiscal", "fiscal code", "IdNr."],
    "dni": ["DNI", "NIF", "ID card", "national ID", "NIE"],
    "pass": ["passport", "Passport", "Reisepass", "passeport", "pasaporte", "Personalausweis", "travel document"],
}
LABEL_ENDS = [" ", " ", " ", ": ", ": ", " : ", "#", "# ", " no. ", " no ", " number ", " number: ", " Nr. ", " núm. ", " n° "]
LABELS_PHONE = ["", "", "", "Tel. ", "Tel: ", "tel ", "T: ", "phone ", "Phone: ", "mobile ", "Mobile: ", "Mob. ", "cell ", "Telefon ", "Handy ", "tél. ", "móvil ", "fax "]
SIGNS = [", ", "; ", " / ", " / ", " - ", " | ", " or ", " and ", ": "]
ROLES = """Applicant Member Patient Guest Passenger Employee Manager Director Teacher Student Driver Owner Tenant Landlord Seller Buyer Witness Partner Supplier Contractor Secretary Notary Trustee Heir Lawyer
Officer Inspector Nurse Pensioner Subscriber Visitor Donor Author Speaker Editor Engineer Trainee Cashier Treasurer Signatory Delegate Agent's Claimant Debtor Creditor Policyholder Shareholder Householder
Colleague Professor Minister Judge Mieter Kundin Kunde Käufer Antragsteller Vertreter Schüler Madame Cliente Locataire Vendeur Directrice Señorita Vecino Gerente Abogado Titular Inquilino""".split()
WORD_NAMES = 0.12  # share of given and family names that are ordinary words of the frames


# Slots: N name, E e-mail, P phone, I identity number, A address, U what follows an address, O organisation, T town, C topic,
# K code, X several words of code, J role, S a sign between two things, W any word of the frames, M money, D date, H time, # number, G another sentence.
POSITIVE = r"""
Dear {N}, thank you for writing to us.
{N} opened the case {K} this morning.
{N} would like a copy of {K}.
We met {N} and {N} in {T}.
Our colleague {N} will call you back about the {C}.
This was agreed with {N} of {O} in {T}.
Payment to {N} went out on {D} ({M}).
Tenant {N} pays {M} every month.
The holder, {N}, moved to {A}{U} last year.
Holder {N}, reference {K}, asked for a new card through {E}.
Client {N} says the {C} is wrong.
Client {N} rang at {H} because of the {C}.
Applicant {N}, born {D}, gave {I}.
Insured person: {N}. Policy {K}.
Signed off by {N} and, for {O}, by {N}.
Released by {N}, {D}.
Authorised: {N}, {N}
Handed over from {N} to {N} at {H}.
In the room were {N}, {N}, {N} and a clerk.
The complaint of {N} concerns {K}.
{N} has left {O}; please remove the entry.
Speak to {N} or {N} if {K} is still open.
Passed on to {N} at {O}.
Forwarded to {N}, {O}, {T}.
If {N} rings, mention {K}.
Only {N} knew that the {C} had changed.
As {N} explained, the {C} from {O} was not sent.
The {C} was found by {N}, a trainee at {O}.
{N}'s refund of {M} is late.
{N}'s file {K} was opened twice.
A cheque over {M} for {N}, {A}{U}.
Deliver to {N}, {A}{U}.
Post it to {A}{U}.
Bills should go to {A}{U} from now on.
The parcel for {A}{U} was returned by the courier.
His flat is at {A}{U}; the previous tenant was {N}.
Visit us: {A}{U}
Registered at {A}{U} since {D}, telephone {P}.
The call came from {P} at {H}.
Ring {P} or, after {H}, {P}.
You can text {P}.
Number to use: {P}
Number to use: {P} - {G}
Her number is {P}, her address {E}.
Reach the team under {P} and {E}.
Send the form to {E} and keep {K} in the subject.
Please answer to {E} with a copy to {E}.
Mail: {E}
The message to {E} could not be delivered.
{N} writes from {E}; the older {E} is closed.
The form gives {I} and {P}.
{I} was typed wrong, we now have {I}.
On the copy one reads {I}, issued {D}.
Proof of identity: {I} ({N})
{N} ({I}) asks about {M}.
{N} showed {I} at the counter in {T}.
The scan has {I}, {P} and {E}.
Verified by {I}. {G}
Der Brief an {N}, {A}{U} kam zurück.
{N} möchte wissen, wo {K} bleibt.
{N} fragt nach der Zahlung über {M}.
{N} dankt für die Antwort auf {K}.
{N} verlangt einen Beleg bis {D}.
{N} erreicht man unter {P} oder {E}.
{N} schickt die Unterlagen an {E}.
{N} souhaite recevoir {K}.
{N} réclame {M} depuis le {D}.
{N} attend une réponse au {P}.
{N} refuse de payer {M}.
{N} solicita una copia de {K}.
{N} pregunta por el pago de {M}.
{N} espera una respuesta en {E}.
{N} vive ahora en {A}{U}.
{N} hopes to hear from {O} by {D}.
{N} wants {M} back.
{N} works for {O} in {T}.
{N} can use {P} until {H}.
Bitte rufen Sie {N} unter {P} an.
{N} wohnt jetzt {A}{U}.
Unterschrieben hat {N}, geprüft {N}.
Gespräch mit {N} am {D} wegen {K}.
Antwort an {E} erbeten.
Ausgewiesen durch {I}.
Überweisung an {N} über {M}, Verwendungszweck {K}.
{N} a téléphoné depuis le {P}.
Merci de répondre à {E}.
Remis à {N}, {A}{U}, le {D}.
La cliente {N} habite {A}{U}.
Signé par {N} à {T}.
Pièce d'identité : {I}
Remboursement de {M} pour {N}.
{N} llamó desde el {P} a las {H}.
La carta para {N} salió hacia {A}{U}.
Firmado por {N} en {T}.
Responda a {E}, por favor.
Identificación: {I}
Devolución de {M} a favor de {N}.
お客様番号 {K}、電話 {P}。
メール {E} までお願いします。
{N} 様からの連絡 ({P})。
From: {N} <{E}>\nTo: {E}\nDate: {D}\n\n{G}
From: {N}\nCc: {N}\nSubject: {C}
To: {N}\nSubject: Re: {K} {C}\n\n{G}
From: {E}\nTo: {E}\nSubject: {K}\n\n{G} {G}
From: {E}\nTo: {E}\n\n{G}
Kind regards\n{N}\n{P}
Yours sincerely,\n{N}
Thanks,\n{N} | {P} | {E}
Mit freundlichen Grüßen\n{N}\n{A}{U}
Cordialement\n{N}
Saludos,\n{N}\n{E}
--\n{N}\n{O}\n{P}
{N}: {G}\nCLERK: {G}\n{N}: {G}
CLERK: {G}\n{N}: {G}
Visitor ({N}): {G}
{D} {H} {N} - {G}
Owner: {N}
Contact person: {N} ({P})
Name: {N}\nAddress: {A}{U}\nPhone: {P}\nEmail: {E}\nID: {I}
{"id": "{K}", "customer": "{N}", "street": "{A}{U}", "text": "{G}"}
{"id": "{K}", "tel": "{P}", "mail": "{E}", "doc": "{I}", "text": "{G}"}
{"id": "{K}", "doc": "{I}", "customer": "{N}", "text": "{G} {N} is waiting for {K}."}
| {K} | {N} | {M} | {C} |
| {N} | {A}{U} | {P} |
{K};{N};{M};{D}
{K},{A}{U},{M}
TRANSFER {K} {N} {M}
SALARY {K} {N} {M}
REFUND {K} {N} {M} {K}
{K} {N} {M} PAID
POS {K} {A} {M}
POS {K} {P} {M}
STANDING ORDER {N} {K} {M}
PMT {K} {A}{U} {M}
- {N} to check {K}
* {P} no answer, {E} bounced
Assigned: {N}; watchers: {N}, {N}
{W} {W} {N} {W} {W}.
{W} {N} {W} {W} {W}.
{W} {W} {W} {N}.
{W} {W} {W} {N} {W}, {W} {W}.
Nothing {W} from {N} {W} {W}.
{W} {W} between {N} and {O} {W}.
He told {N} to wait.
This is for {N}.
These papers belong to {N}.
Call {N}.
We saw {N} today.
Hand it to {N}, please.
She knows {N} well.
Who is {N}?
{N} is ill.
{N} has no account.
A friend of {N} paid {M}.
Met with {N} in {T} on {D}.
Paid by {N} on {D}.
Drawn up by {N}.
For {N} only.
{J} {N} asked about the {C}.
{J} {N} lives at {A}{U} and pays {M}.
{J} {N}: {I}
{J} {N} ({I}) signed on {D}.
{J} {N}, file {K}, wrote on {D}.
{J} {N} wrote from {E} at {H}.
the {J} {N} came to {T}
New details: {P}{S}{E}
Details on the sheet: {I}{S}{P}{S}{E}
They gave {P}{S}{I}.
{A}{S}{P}
{E}{S}{P}{S}{N}
Between {N}{S}{N} nothing was agreed.
While {N} was away, {O} closed {K}.
After {N} had paid, {M} was left.
Since then {N} uses the old {C}.
Yesterday {N} said that {O} would pay.
No one except {N} could see {K}.
Her card shows {I} and the date {D}.
Both numbers, {I} and {I}, were sent.
""".strip().split("\n")
NEGATIVE = r"""
{W} {W} {O} {W} {W}.
{W} {W} {W} in {T} {W}.
{W} {W} from {T} {W} {W}.
Thank you for your message about the {C}.
The {C} of {M} was paid on {D}.
Please find the {C} for {D} enclosed.
Order {K} contains {#} items, see {K}.
Card ending {K} was used for {M} at {H}.
Account {K} was opened in {T}.
Your account {X} has {#} new entries.
Ticket {X}: {#} lines were wrong.
Flight {K} to {T} leaves at {H}.
Booking {X} is confirmed for {#} nights in {T}.
Our branch in {T} is closed on Monday.
The office of {O} in {T} opens at {H}.
{O} from {T} has sent {K}.
{O} sold {#} shares to {O}.
{O} accepted the {C} of {M} on {D}.
{O} and {O} share one account in {T}.
Invoice {K} of {O} over {M} is open.
Only {O} uses {X}.
Ask {O} for the {C}, not {O}.
We have moved from {T} to {T}.
Trains between {T} and {T} were late on Friday.
Meeting on Tuesday about the {C}, second floor, room {#}.
January, March and October are the months with the most claims.
Black Friday and Easter Monday change the {C}.
Turn left at the second street and follow the road to the square.
The street lights in {T} cost {M}.
Row {#} of {#} was not read, column {#} is blank.
Use 2 way locks and 6 place decimals in {T}.
Court costs of {M} and {#} lane closures were listed.
Version {K} replaces {K}.
Version {K} runs since {D} {H} on node {#}.
Job {X} ended with code {#} after {#} seconds.
Worker {#} stopped at {H}, queue length {#}, memory {#}.
Checksum {X} differs from {X}.
ERROR {D} {H} loader file={K} rows={#} status=FAILED
{D}T{H}Z INFO scheduler task={X} retries={#} state=RUNNING
INFO {K} started, {#} threads
SELECT name, total FROM orders WHERE id = '{K}' AND total > {#};
UPDATE accounts SET state = 'CLOSED' WHERE code = '{K}'; -- {#} rows
The rule {K} was skipped because {K} had already fired.
Result ACCEPTED, {#} of {#} checks passed.
Result: NOT FOUND ({K})
Status of {K} is PENDING, of {K} it is DONE.
{K} PENDING {M}
{K} / DONE
[{K}] FAILED: {G}
{K} - {C}: {G}
| {K} | {C} | {M} | PENDING |
| Code | Amount | State |
{K};{D};{M};{K};DONE
TRANSFER {K} {O} {M}
POS {K} {O} {M}
REFUND {K} {O} {M} {K}
Die Prüfung von {K} dauert bis {D}.
Zum Abgleich fehlt {K}, zur Freigabe auch {X}.
STANDING ORDER {O} {K} {M}
PMT {K} {O} {M}
# Weekly notes {K}
## Part {#}
## Open points for {T}
Re: {C} {K}
Subject: {C}\n\n{G} {G}
Hello,\n\n{G}
CLERK: {G}\nVISITOR: {G}\nCLERK: {G}
VISITOR: {G}
Why is the {C} late? Because {O} closed early.
Should the {C} be higher? Yes, by {M}.
May we close {K}? Not before {D}.
Mark every line of {X} as read.
Bill all {C} items at once, then pay.
Rich data helps: {#} percent of the {C} cases were found.
Hope and patience are needed until {D}.
Art is sold in {T}; art dealers pay {M}.
Grace period of {#} days for {K}.
Will this end soon? The {C} says so.
Rose prices rose by {M} in {T}.
Chase the {C} before {H}.
Section {#} of the contract with {O} rules the {C}.
Article {#} and Annex {K} were signed in {T}.
According to Section {#} the {C} falls due on {D}.
Compare {K} with {K}: no field is equal.
Two records of {K} carry {M} and {M}.
The pair {K} and {K} stays undecided.
Net {M}, fee {M}, total {M} in EUR, USD or GBP.
Rates per unit: 4.20, 18.75 and 230.10 each @ 3.50.
Contact sheet {K} was printed @help-desk for all teams.
Phone costs of {M} were shared by {#} people.
Die Rechnung {K} wurde am {D} bezahlt.
Der Auftrag {K} enthält {#} Positionen aus {T}.
Die Datei {K} fehlte um {H} noch und fehlt im Bericht.
Das Lager in {T} bleibt bis Montag geschlossen.
Für den Vertrag {X} gilt der Preis vom {D}.
{O} hat die Lieferung von {T} nach {T} storniert.
Ergebnis: {#} Treffer, Regel {K}.
Bitte die Summe {M} prüfen und die Meldung schließen.
La facture {K} du {D} reste impayée.
Le dossier {X} contient {#} pages.
Le fichier {K} est parti à {H}, trop tard pour {T}.
Notre bureau de {T} ferme le vendredi.
{O} a annulé la commande de {M}.
Résultat : {#} lignes, règle {K}.
Une erreur de {M} a été vue sur le compte {X}.
La factura {K} del {D} sigue pendiente.
El pedido {X} tiene {#} productos.
El archivo {K} salió hacia las {H} y no se pudo leer.
Nuestra tienda de {T} cierra el lunes.
{O} canceló el envío de {M}.
Resultado: {#} líneas con la norma {K}.
Hay una diferencia de {M} en la cuenta {X}.
注文 {K} の合計は {M} です。
口座 {X} に {#} 件の入金がありました。
締切は {D} の {H} です。
Serial {X}, batch {K}, shelf {#}.
The hash begins with {X} on both hosts.
Old and new value of {K}: {#} and {#}.
Nothing changed in {K} on {D}.
Closed without action: {K}.
{J} number {K} was not found.
{J} and {J} must both sign before {D}.
Every {J} of {O} gets {M}.
The {J} of {T} opens the hall at {H}.
Reference {K}, hash {X}, worker {#}, retry {#}.
Prefix {X} stands in both files.
{X} was entered as a reference, not as a person.
{C} {K}\n\n{G}
""".strip().split("\n")


# Very frequent words of the languages, beside those of the frames.
COMMON = """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would
their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such
like our over me even most made after also did many before must through back years where much your way well down should because each just those how too der die und das den
von zu ist mit des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum haben nur oder aber
vor zur bis mehr durch man dieser le la les et des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux ont cette sa été leur mais ou nous
comme el los las que por una con para del se su al lo es más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde""".split()


def frame_words() -> list[str]:
    """The words of the frames in lower case, in order."""
    fixed = [re.sub(r"\{.\}|\\n", " ", p) for p in POSITIVE + NEGATIVE] + TOPICS
    fixed += [x for labels in LABELS_ID.values() for x in labels] + LABEL_ENDS + LABELS_PHONE
    return sorted({w.casefold() for p in fixed for w in re.findall(r"[^\W\d_]+", p)})


SMALL = sorted(set(frame_words()) | set(COMMON))
WORDS = [w for w in frame_words() if len(w) > 3 and w.isascii()]


class Maker:
    """Fills the slots; every method gives text with marks."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))

    def invented(self) -> str:
        r = self.r
        middle = "".join(r.choice(CODAS) + r.choice(VOWELS) for _ in range(r.choice([0, 0, 1, 1, 2])))
        return r.choice(ONSETS) + r.choice(VOWELS) + middle + r.choice(CODAS) + r.choice(LASTS)

    def pick(self, known: list[str], like: str = "{}") -> str:
        """One of the list, or an invented word in its place."""
        return like.format(self.invented()) if self.r.random() < INVENTED else self.r.choice(known)

    def surname(self) -> str:
        return self.word() if self.r.random() < WORD_NAMES else self.pick(FAMILY)

    def given(self) -> str:
        return self.word() if self.r.random() < WORD_NAMES else self.pick(GIVEN)

    def word(self) -> str:
        """An ordinary word as a name."""
        return self.r.choice(WORDS).capitalize()

    def name(self) -> str:
        r = self.r
        g, s = self.given(), self.surname()
        k = r.random()
        if k < 0.12:
            s += "-" + self.surname()
        elif k < 0.24:
            s = r.choice(PARTICLES) + s
        form = r.choice(FORMS) + " " if r.random() < FORM_SHARE else ""
        k = r.random()
        initial = r.choice("ABCDEFGHIJKLMNOPRSTVWYZ")
        if form and k < 0.55:
            n = s
        elif k < 0.50:
            n = f"{g} {s}"
        elif k < 0.62:
            n = f"{g} {initial}. {s}"
        elif k < 0.78:
            n, form = f"{s}, {g}" + (f" {initial}." if r.random() < 0.15 else ""), ""
        elif k < 0.90:
            n = f"{g[0]}. " + (f"{initial}. " if r.random() < 0.2 else "") + s
        elif k < 0.94:
            n = f"{g} {self.given()} {s}"
        else:
            n = f"{g} {s}"
        case = r.random()
        n = n.upper() if case < 0.08 else n.lower() if case < 0.10 else n
        return f"{form}‹NAME:{n}›"

    def org(self) -> str:
        r = self.r
        s = self.surname()
        o = r.choice([
            f"{s} {r.choice(ORG_WORDS)}", f"{s} {r.choice(LEGAL)}", f"{s} {r.choice(ORG_WORDS)} {r.choice(LEGAL)}", f"{s} & {self.surname()} {r.choice(LEGAL)}", f"{s}, {self.surname()} & Partners",
            f"{r.choice(['Bank', 'Banque', 'Banco', 'Banca', 'Sparkasse', 'Caixa', 'Crédit', 'Grupo'])} {s}", f"{s} {r.choice(['Bank', 'Trust', 'Foundation', 'University', 'Hospital', 'Hotel'])}", f"{self.given()} {s} {r.choice(LEGAL)}", f"{r.choice(ORG_WORDS)} {s} {r.choice(LEGAL)}", f"{s} {self.word()}", f"{s} {self.word()}",
        ])
        return o.upper() if r.random() < 0.06 else o

    def town(self) -> str:
        if self.r.random() >= INVENTED:
            return self.r.choice(TOWNS)
        w = self.invented()
        return self.r.choice(TOWN_PARTS).format(w, l=w.lower())

    def code(self) -> str:
        """A reference of some company: letters, digits and signs in any arrangement."""
        r, d = self.r, self.digits
        k = r.random()
        if k < 0.35:
            return self.letters(r.randint(1, 4)) + r.choice(["", "-", "/", " ", "#"]) + d(r.randint(3, 9))
        if k < 0.5:
            return self.letters(r.randint(2, 3)) + r.choice("-/") + d(r.randint(2, 4)) + r.choice("-/") + d(r.randint(2, 6)) + r.choice(["", "", "-" + d(4)])
        if k < 0.65:
            return r.choice(["file", "run", "feed", "lot", "job", "node", "src"]) + "-" + r.choice(["a", "x", "main", "eu", "us"]) + r.choice(["", "-old", "-ab", "-tok"]) + r.choice(["", "-" + d(r.randint(2, 6))])
        if k < 0.75:
            return self.invented()[:3].capitalize() + r.choice("/-") + d(r.randint(3, 6))
        if k < 0.85:
            return f"{r.choice(['rule', 'format', 'key', 'policy', 'scheme'])}_v{r.randint(1, 9)}"
        return d(r.randint(4, 12))

    def codes(self) -> str:
        r, d = self.r, self.digits
        return r.choice([
            lambda: self.letters(r.randint(2, 4)) + "-" + d(r.randint(5, 9)), lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"{d(4)}-{d(4)}", lambda: "**** " + d(4), lambda: f"{self.letters(2)}{d(2)} {d(4)} {d(4)} {d(4)}",
            lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(6, 16))), lambda: f"{d(3)}-{d(2)}-{d(5)}", lambda: d(r.choice([6, 7, 8, 10, 12])), lambda: f"{d(4)}-{d(2)}-{d(4)}", lambda: f"{self.letters(1)}{d(4)}{self.letters(2)}",
        ])()

    def ascii(self, s: str) -> str:
        return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower().replace("'", "").replace(" ", "")

    def email(self) -> str:
        r = self.r
        g, s = self.ascii(self.given()) or "li", self.ascii(self.surname()) or "ng"
        local = r.choice([f"{g}.{s}", f"{g}_{s}{r.randint(1, 99)}", f"{g[0]}{s}", f"{s}-{g}", f"{g}{r.randint(1950, 2005)}", f"{g}.{s}+shop", f"{s}.{g[0]}", r.choice(["info", "help", "sales", "office", "accounts", "support", "hr", "do-not-reply", "front.desk"])])
        host = r.choice(["", "", "mail.", "eu.", "post."]) + self.ascii(self.pick(FAMILY)) + r.choice(["", "", "bank", "mail", "-shop", "soft", "pay"]) + r.choice([".com", ".org", ".net", ".de", ".co.uk", ".fr", ".es", ".example", ".test", ".example.com", ".invalid"])
        k = r.random()
        if k < 0.72:
            e = f"{local}@{host}"
            e = e.title() if k < 0.05 else e.upper() if k < 0.1 else e
            out = f"‹EMAIL:{e}›"
            return f"<{out}>" if k > 0.6 else f"mailto:{out}" if k > 0.54 else out
        at = r.choice([" [at] ", "[at]", " (at) ", "(at)", " AT ", " at "])
        dot = "." if at.strip(" []()") == "at" and "[" in at + "(" and r.random() < 0.4 and at != " at " else r.choice([" [dot] ", " (dot) ", " dot "])
        return f"‹EMAIL:{local}{at}{host.replace('.', dot)}›"

    def phone(self) -> str:
        d, r = self.digits, self.r
        h, z = r.choice("--‑"), r.choice("23456789")
        us = z + d(2)
        p = r.choice([
            f"+1 {us}{h}{d(3)}{h}{d(4)}", f"+1{us}{d(7)}", f"({us}) {d(3)}{h}{d(4)}", f"{us}.{d(3)}.{d(4)}", f"{us}{h}{d(3)}{h}{d(4)}", f"+44 {z}{d(1)} {d(4)} {d(4)}", f"0{z}{d(1)} {d(4)} {d(4)}", f"07{d(3)} {d(6)}", f"07{d(3)} {d(3)} {d(3)}", f"0044 (0)7{d(3)} {d(3)} {d(3)}",
            f"+33 {z} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{z} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(3)} {d(3)} {d(3)}", f"0{z}0/{d(5)}{h}{d(3)}", f"+49 (0){z}{d(1)} {d(5)} {d(3)}", f"+34 {z}{d(2)} {d(3)} {d(3)}", f"+49 {z}{d(2)} {d(7)}", f"0{d(3)} {d(5)}", f"+61 {z} {d(4)} {d(4)}",
        ])
        return f"{r.choice(LABELS_PHONE)}‹PHONE:{p}›"

    def ident(self) -> str:
        d, r = self.digits, self.r
        kind = r.choice([*LABELS_ID, "tax", "ssn"])
        sp = r.random() < 0.5
        two = self.letters(2)
        bare = kind not in ("tax", "pass") and r.random() < 0.15
        label = "" if bare else r.choice(LABELS_ID[kind]) + r.choice(LABEL_ENDS)
        v = {
            "ssn": f"{d(3)}-{d(2)}-{d(4)}" if bare else r.choice([f"{d(3)}{s}{d(2)}{s}{d(4)}" for s in ("-", " ", ".", "", "", "-")]),
            "ni": f"{two} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}" if sp else f"{two}{d(6)}{r.choice('ABCD')}",
            "nir": f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}" if sp else f"{r.choice('12')}{d(12)}",
            "tax": f"{d(2)} {d(3)} {d(3)} {d(3)}" if r.random() < 0.3 else d(11),
            "dni": f"{d(8)}{r.choice(['', ' ', '-', ''])}{r.choice('ABCDEFGHJKLMNPQRSTVWXYZ')}",
            "pass": f"{two}{d(7)}" if sp else f"{two[0]}{d(8)}",
        }[kind]
        if kind in ("ni", "pass") and r.random() < 0.1:
            v = v.lower()
        return f"{label}‹ID_NUMBER:{v}›"

    def address(self) -> str:
        r = self.r
        n = str(r.choice([r.randint(1, 40), r.randint(41, 999), r.randint(1000, 9999)]))
        k = r.random()
        if k < 0.5:
            a = f"{n}{r.choice(['', '', '', '', 'a', 'b', 'C', 'B'])} {r.choice(['', '', '', 'N. ', 'S ', 'West '])}{self.pick(EN_STREETS)} {r.choice(EN_KINDS)}"
        elif k < 0.66:
            s, kind = self.pick(DE_STREETS), r.choice(DE_KINDS)
            street = f"{s}-{kind.title()}" if r.random() < 0.25 else s + kind
            a = f"{street} {n}{r.choice(['', '', '', 'a', ' b'])}"
        elif k < 0.83:
            a = f"{n}{r.choice(['', '', '', ' bis'])}{r.choice([', ', ' ', ', '])}{r.choice(FR_KINDS)} {self.pick(FR_STREETS, r.choice(['de {}', 'du {}', 'des {}s', 'de la {}']))}"
        else:
            a = f"{r.choice(ES_KINDS)} {self.pick(ES_STREETS, r.choice(['de {}', 'del {}', 'de la {}']))}{r.choice([' ', ', ', ' nº '])}{n}"
        return f"‹ADDRESS:{a.upper() if r.random() < 0.06 else a}›"

    def unit(self) -> str:
        r = self.r
        u = r.choice(["", "", "", f", Apt {r.randint(1, 60)}", f", Flat {r.randint(1, 60)}", f", Unit {r.randint(1, 60)}", f", Suite {r.randint(1, 60)}", f" #{r.randint(1, 60)}", f", {r.randint(1, 9)}º B", f", Floor {r.randint(1, 60)}"])
        t = self.town()
        return u + r.choice(["", "", f", {t}", f", {t} {self.digits(5)}", f", {self.digits(5)} {t}"])

    def number(self) -> str:
        return str(self.r.choice([self.r.randint(1, 9), self.r.randint(10, 99), self.r.randint(100, 9000)]))

    def money(self) -> str:
        d, r = self.digits, self.r
        v = r.choice([f"{r.randint(1, 99)}.{d(2)}", f"{r.randint(100, 999)}.{d(2)}", f"{r.randint(1, 99)},{d(3)}.{d(2)}", str(r.randint(1, 999)), f"{r.randint(1, 99)}.{d(3)},{d(2)}"])
        c = r.choice(["EUR", "USD", "GBP", "CHF", "JPY", "INR", "AUD", "SEK", "CAD", "€", "$"])
        return f"{c}{v}" if c == "$" else f"{c} {v}" if r.random() < 0.2 else f"{v} {c}"

    def day(self) -> str:
        r = self.r
        y, m, d = r.randint(2015, 2029), r.randint(1, 12), r.randint(1, 28)
        month = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"][m - 1]
        return r.choice([f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{d} {month} {y}", f"{d:02}/{m:02}/{y}", f"{month} {d}, {y}"])

    def hour(self) -> str:
        h, m, s = (self.r.randint(0, 23), self.r.randint(0, 59), self.r.randint(0, 59))
        return self.r.choice([f"{h:02}:{m:02}", f"{h:02}:{m:02}:{s:02}", f"{h}:{m:02} UTC"])

    def fill(self, pattern: str) -> str:
        out, rest = [], pattern.replace("\\n", "\n")
        slots = {
            "N": self.name, "E": self.email, "P": self.phone, "I": self.ident, "A": self.address, "U": self.unit, "O": self.org, "T": self.town, "K": self.code, "X": self.codes, "M": self.money, "D": self.day, "H": self.hour, "#": self.number,
            "C": lambda: self.r.choice(TOPICS), "W": lambda: self.r.choice(SMALL), "J": lambda: self.r.choice(ROLES), "S": lambda: self.r.choice(SIGNS), "G": lambda: self.fill(self.r.choice([p for p in NEGATIVE if "\\n" not in p and p[0] not in "#|["])),
        }
        while (i := rest.find("{")) >= 0:
            if rest[i + 2 : i + 3] != "}":
                out.append(rest[: i + 1])
                rest = rest[i + 1 :]
                continue
            out += [rest[:i], slots[rest[i + 1]]()]
            rest = rest[i + 3 :]
        return "".join(out) + rest


def labelled_rows(rows: int = 6000, seed: int = 11) -> list[str]:
    """rows marked texts (the bound on the training table is this parameter)."""
    m = Maker(seed)
    out = []
    for i in range(rows):
        text = m.fill(POSITIVE[i // 2 % len(POSITIVE)] if i % 2 == 0 else m.r.choice(POSITIVE + NEGATIVE * 2))
        while m.r.random() < 0.45:
            text += m.r.choice([" ", " ", "\n", "\n\n", "\n- "]) + m.fill(m.r.choice(POSITIVE + NEGATIVE * 2))
        k = m.r.random()
        if k < 0.04:
            text = unicodedata.normalize("NFD", text)
        elif k < 0.10:
            text = "".join(part.upper() if i == 0 else "‹" + part.split(":", 1)[0] + ":" + part.split(":", 1)[1].upper() for i, part in enumerate(text.split("‹")))
        elif k < 0.20:
            width, line, new = m.r.randint(30, 60), 0, []
            for ch in text:
                line = 0 if ch == "\n" else line + 1
                if ch == " " and line > width:
                    ch, line = "\n", 0
                new.append(ch)
            text = "".join(new)
        out.append(text)
    return out


def unmark(row: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text of a marked row and its spans (type, start, end)."""
    text, spans = "", []
    for i, part in enumerate(row.split("‹")):
        if i == 0:
            text += part
            continue
        body, tail = part.split("›", 1)
        kind, span = body.split(":", 1)
        spans.append((kind, len(text), len(text) + len(span)))
        text += span + tail
    return text, spans
