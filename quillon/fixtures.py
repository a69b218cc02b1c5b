"""Small invented documents that hold what the synthetic tables lack; every value is fictional."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.files import spread

ORDER_FR = """# Fichier source: bon_de_commande_17.pdf
Fabrik Nord SAS
12 rue des Tanneurs
75011 PARIS
Tél. 01 44 55 66 77 - contact@fabrik-nord.example
SIRET 123 456 789 00012 - APE : 2562B - au capital de 120 000 EUR
TVA FR 40 123 456 789
N° de compte : 00012345678
Votre commande : 4500123456
Code client : C-00417
Affaire n° : AF-2210
Suivi par : M. Julien MARCHAND
RIB : 30002 00550 0000157841Z 25
IBAN FR14 2004 1010 0505 0001 3M02 606
BIC PSSTFRPPPAR
Date de naissance : 12/03/1980
"""
ORDER_EN = """Northwind Tools Ltd.
48 Mill Lane, London SW1A 2AA
Phone: +44 20 7946 0018
Purchase order no: 4700123456
Customer code: NW-20931
Attention of: John Whitfield
UTR: 1234567890
National Insurance Number: QQ 12 34 56 C
Incoterm: DAP Rotterdam
Shipment by UPS 1Z999AA10123456784
Yours sincerely, Mr John Whitfield
(special offer for WHITFIELD only)
"""
ORDER_DE = """Werkzeug Nord GmbH
Lindenstraße 12
20095 Hamburg
Postfach 1234
HRB 12345
USt-IdNr. DE123456789
Telefon +49 40 1234567
Ansprechpartner: Herr Karl Lindner
IBAN DE89 3704 0044 0532 0130 00
Mit freundlichen Grüßen
Karl Lindner
"""
TABLE = """Client
Votre commande

C-55120
4500987654
Désignation Quantité Prix Unité Total
Vis M8 inox 100 pcs 12,50
Roulement 6204ZZ 4 pcs 32,00
Total HT 44,50
Conditions de paiement
Dupont Industries
"""
OTHER = """NIP: 526-10-40-828 REGON: 123456785 KRS: 0000123456 PESEL: 44051401359
Codice fiscale RSSMRA85T10A562S
ЕГН: 7523169263
マイナンバー：123456789018
身份证号: 11010519491231002X
RČ: 736028/5163 IČO: 12345679 DIČ: CZ12345679
T.C. Kimlik No: 10000000146
DNI: 12345678Z NIE X1234567L
"""
NUMBERS_WEST = """Numéro de sécurité sociale : 1.85.05.78.006.084.36 et aussi 185057800608436
Sans contexte plus loin, ici une ligne assez longue pour éloigner tout libellé du nombre qui suit : 285057800608436
N° URSSAF : 117 1234567 89, n URSSAF 1171234567
National Insurance Number QQ 12 34 56 C; code AB 12 34 56 D far from any label that would tell what the letters and the digits stand for here
Driving licence no MORGA657054SM9IJ, driver's license ABCDEFGHIJ
UTR: 12345 67890 Unique Taxpayer Reference 123-456-7890
HMRC-123-4567-89 HMRC 123 456
DNI 12345678Z, 87654321X; NIE: X1234567L y Y7654321M, Z123
CIF: B 12345678 NIF A-87654321 otro dato que queda lejos de toda etiqueta y no cuenta como tal: C12345678
CCC: 28/12345678/90 cuenta de cotización 08 1234567 12
NIF: 123 456 789 contribuinte 987654321 e depois um texto sem nada 555444333
Cartão de cidadão 123 456 789 ZZ 1 (CC) CC: 111 222 333 AB
NISS 12345678901 segurança social número 11 1234 5678 90
HRB 12345 HRA: 998 HR 55
Sozialversicherungsnummer 12 150780 J 009 Steuer-ID: 12 345 678 901 Mitgliedsnummer ABCDEFGH
Codice fiscale RSSMRA85T10A562S; RSSMRA85T10A562 no
Codice SDI: ABC1234 codice destinatario 0000000 SDI XY
Albo Nazionale: IT12345678901, INPS 1234567890, INAIL 12.345.678-AB, matricola 999
Tessera Sanitaria 80380000100123456789/1
CNI n° 880692310285 DNI nº 11223344B Personalausweis-Nr. L01X00T47 registre national 85.07.30-033.28
Account No: 12-3456-7890 1234 N° de compte 000123456789 A/C No. 55
"""
NUMBERS_EAST = """NIP 526-10-40-828 oraz NIP: PL 5261040828, NIP brak
REGON 123456785, REGON: 12345678512347, REGON 123
KRS: 0000123456 KRS 123
PESEL 44051401359 PESEL: 4405140135
T.C. Kimlik No: 10000000146 TCKN 20000000148 Kimlik Numarası 123
VKN: 1234567890 Vergi Kimlik No 0987654321
SGK No 12 34 56 78 901 234 / 56 SGK: 1234-567890-12
Ticaret Sicil No: 123456 MERSİS No 0123456789012345 Sicil No 99
Rodné číslo: 736028/5163, RČ 7360285163, RC bez čísla
IČO: 12345679 IČO 123 Identifikační číslo 87654321
DIČ CZ12345679 DIČ: SK1234567890 DIČ DE123
Občanský průkaz: 123456789 číslo OP AB123456 OP číslo bez
ČSSZ: 1234-56789-12 Evidenční č. ČSSZ 12 345678
身份证号: 11010519491231002X 身份证 110105194912310021 身份证 1101
统一社会信用代码：91350211M000100Y43 USCC 91350211M000100Y4
HKID: A123456(7) HKID AB9876543 HKID none
护照号码 E12345678 passport number G7654321 护照 12
口座番号：1234567 账号: 6222 0212 3456 7890 123
マイナンバー：1234 5678 9018 個人番号 123456789018 マイナンバー 12
法人番号: 1234567890123 Corporate Number 1-2345
運転免許証番号：123456789012 運転免許証 12
パスポート番号: TR1234567 旅券番号 TK 99
健康保険証番号 1234-5678 保険証番号：12345678
登記番号 0100-01-123456 法人登記番号：123456-1234567
사업자등록번호 123-45-67890 법인등록번호: 110111-1234567
주민등록번호 900101-1234567 RRN: 900101-9234567
ЕГН: 7523169263 EGN 7552010005 ЕГН 12
ЕИК 123456789 БУЛСТАТ: 1234567890123
ЛНЧ: 1000000000 LNCH 99
Лична карта № 123456789 Паспорт A12345678
НЗОК 12345678 Здравна книжка: 123
"""
CONTACT_FR = """Tél : 01 44 55 66 77, portable 06.12.34.56.78, +33 1 44 55 66 77 et 0033 (0)1 44 55 66 77, Fax 144556677
Réf 0144556677123 et 12/03/2020, 01 44 55
+32 2 123 45 67 ou (+32) 475 12 34 56; +44 20 7946 0018; +61 2 9374 4000; +49 (0) 30 123456; +351 21 123 4567
contact@fabrik-nord.example, achats+eu@sub.fabrik.example, pas@un, www.fabrik-nord.fr/contact, https://docs.fabrik.com, fabrik.community
12 rue des Tanneurs 75011 PARIS CEDEX
Avenue de la Gare, Z.I. de la Plaine, BP 1234, C.S. 40012
3 bis, impasse du Moulin
69003 Lyon, 13002 MARSEILLE, 44000 quantite, 31000 Toulouse montant
FRANCE 59000
25 place Bellecour
SIRET 123 456 789 00012 RCS Paris B 123 456 789 TVA FR 40 123 456 789 APE : 2562B NAF 6201Z 4711F au capital de 120 000 EUR capital 50 €
WEEE-Reg.-Nr. DE 12345678, Numéro de TVA : FR40123456789, VAT no. GB123456789
M. Julien MARCHAND, Mme Anne Petit, Monsieur Paul, MARTIN, Jean et DURAND, Luc Henri; Suivi par Claire Fontaine; Marc Dubois sans titre; Julie ROBERT
née Lefebvre, née le 12/03/1980, nee et
Commercial : DUPONT Commercial Total Acheteur : Claire Bon
Usine de Villefranche, site de production, Dépôt Grand Ouest, agence de Bordeaux, Lyon Sud Est
DAP Rotterdam, EXW Usine, FOB LE, FCA Saint Denis, CIF destination Anvers
(offre DUPONT), (tout petit), (NORME ABCDEF), (Bosch Rexroth)
M.E.D
Fabrik Nord SAS, Atelier Central SARL, Petit Sas, Grand Hotel S.A.
Service comptabilité
Comptabilité fournisseurs
"""
CONTACT_EN = """Call (743) 555-3824, +1 743 555 3824, 743.555.3824, 7435553824, 12345678901; UK +44 (0)20 7946 0018; +353 1 123 4567; +64 4 123 4567
48 Mill Lane, 1600 Pennsylvania Avenue, 5 High Street, 7 Elm
London SW1A 2AA, Leeds LS1 4AP, K1A 0B1, K1A0B1, 90210, 90210-1234, 12345 678
P.O. Box 123, PO Box 7, Post Office Box 99
Riverside Business Park, Industrial Estate North, Tower Bridge House, Suite 400B, Building A
Mr John Whitfield, Mrs. Jane Doe Smith, Dr Alan, contact Peter Parker, Attention Mary Jones of Acme; Bruce Wayne alone
born Smith, born the, office in Manchester, plant at Coventry, headquarters Bristol Temple
Northwind Tools Ltd, Acme Widgets LLC, Blue Sky Corp, inc
United Kingdom and United States
"""
CONTACT_DE = """Telefon +49 40 1234567, 040 / 123 45 67, (089) 1234-567, 0123, +41 44 123 45 67
Lindenstraße 12, Hauptstr. 5a, Am Markt, Bahnhofplatz 1, Gartenweg
20095 Hamburg, D-80331 München, 1010 Wien, 12 Ort
Postfach 1234, Postfach 10 20 30
Gewerbegebiet Süd, Industriepark Höchst, Gebäude C, Haus Sonne, Werk Zwei
Herr Karl Lindner, Frau Dr. Anna Schmidt, Sehr geehrter Herr Meyer, Prof. Otto
Geschäftsführer der Sitz der Gesellschaft, Niederlassung in Köln, Standort Berlin Mitte
Werkzeug Nord GmbH, Alpha Beta AG, Registergericht
USt-IdNr. DE123456789
"""
CONTACT_SOUTH = {
    "es": """Teléfono 912 345 678, 612 34 56 78, +34 912345678, +52 55 1234 5678, +54 11 4123 4567, 512345678
Calle de Alcalá 5, Avenida Diagonal, Plaza Mayor 1, C/Sol, 28013 Madrid, 08001 BARCELONA
Apartado de Correos 123, Apdo 7, Polígono Industrial de Valencia, Edificio Torre Norte, Nave 5
Sr. Juan García, Sra. Ana López Ruiz, Don Pedro, contacto Luis Gómez; sucursal de Sevilla, sede en Toledo
España, Atentamente, Sociedad Anonima
""",
    "it": """Tel. +39 06 1234 5678, 02 1234567, 333 123 4567, 12
Via Roma 5, Piazza del Duomo 1, Corso Como, 00184 Roma, 20121 MILANO
Casella Postale 12, C.P. 345, Zona Industriale di Torino, Palazzo Blu, Capannone 7
Sig. Mario Rossi, Dott.ssa Anna Bianchi, Ing. Luca, contatto Paolo Verdi; filiale di Genova, sede a Napoli
Italia, Cordiali saluti, S.p.A.
""",
    "pt": """Tel. +351 21 123 4567, 212 345 678, +55 (11) 91234-5678, 9123
Rua de Santa Catarina 5, Avenida da Liberdade, 1250-096 Lisboa, 4000-123 PORTO, 01310-100 São Paulo
Apartado 123, Zona Industrial de Braga, Edifício Central, Bloco B
Sr. João Silva, Dra. Maria Costa, Eng. Rui, contacto Pedro Nunes; filial do Porto, sede em Lisboa
Portugal e Brasil, CNPJ, Lda
""",
    "bg": """ул. Витоша 5, бул. България 10, 1000 София, ет. 3, ап. 12, вх. Б
г-н Иван Петров, г-жа Мария Иванова, Георги Димитров, контакт Петър Колев
България, ЕООД, фактура, Република България
""",
    "nl": """1234 AB Amsterdam, 1012JS, 12-345 Warszawa, 110 00 Praha, 4000-123
Postcode SW1A 2AA, 99 999, 00-001
""",
    "pl": """00-950 Warszawa, 31-042 Kraków, 123-456
""",
}
ORDERS = """DHL 1234567890, DHL : 12345, UPS 1Z999AA10123456784 et 1Z999, colis RA123456789FR, FedEx 123456789012 FedEx 12345
GLS 12345678901, DPD 12345678901234, TNT 123456789, Schenker 12345678, GLS 99
N° de suivi : AB12345678, tracking number 998877 Suivi colis X1
Affaire n° : AF-2210, N° dossier 2024-17, dossier n° TVA, affaire sans numéro
Banque : Crédit Lointain
Domiciliation bancaire : voir annexe
Code banque : 30002 code guichet 00550 N° de compte : 0000157841 clé RIB 25
Virement à la Banque Postale ou Deutsche Bank, Banque de France
Facture du 12032020 ou 20200312, réf 99999999, Jean Dupont
"""
#: (doc_id, lang, text): ids are negative, so they meet no table's.
DOCUMENTS = [(-1, "fr", ORDER_FR), (-2, "en", ORDER_EN), (-3, "de", ORDER_DE), (-4, "fr", TABLE), (-5, "pl", OTHER)]
#: More of the same kind: what detectors find and what looks like it.
DOCUMENTS += [(-6 - n, k, t) for n, (k, t) in enumerate([("fr", NUMBERS_WEST), ("pl", NUMBERS_EAST), ("fr", CONTACT_FR), ("en", CONTACT_EN), ("de", CONTACT_DE), ("fr", ORDERS), *CONTACT_SOUTH.items()])]
#: Lexicon words for the fixtures' table.
LEXICON = ("désignation", "quantité", "prix", "unité", "total", "vis", "roulement", "conditions", "paiement")


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, k, "fixture") for i, k, t in DOCUMENTS], "doc_id long, text string, lang string, source string")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the table, and the fixtures."""
    table = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return table.unionByName(documents(spark).select("doc_id", "text", F.col("lang"), "source"))
