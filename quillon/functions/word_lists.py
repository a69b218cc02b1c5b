"""Word lists, tables and small patterns of the rules: fixed values, as text."""

INCOTERM_NOT_LOCATION = (
    "arrivee", "arrivée", "bestimmungsort", "carrier", "commercial", "compris", "consegna", "delivered", "delivery", "depart", "destinataire",
    "destination", "destinazione", "destino", "duties", "duty", "départ", "entregada", "entregue", "exclu", "exclus", "frais", "franco", "free",
    "frei", "freight", "geliefert", "inclus", "incoterm", "incoterms", "international", "lieferung", "lieu", "livraison", "livre", "livree",
    "loaded", "lugar", "luogo", "named", "paid", "place", "porto", "puerto", "rendu", "rendue", "shipping", "termes", "transfert", "transport",
    "transporteur", "unloaded", "unverzollt", "verzollt", "ware", "warehouse",
)
SITE_KEYWORDS = {
    "fr": {
        "keywords": (
            "agence", "site", "bureau", "etablissement", "usine", "depot", "succursale", "implantation", "antenne", "filiale", "siege", "centre",
        ),
        "prepositions": ("de", "d'", "du", "des", "a"),
    },
    "en": {
        "keywords": (
            "office", "branch", "facility", "plant", "site", "warehouse", "location", "headquarters", "hq", "subsidiary", "depot",
        ),
        "prepositions": ("in", "of", "at"),
    },
    "de": {
        "keywords": (
            "niederlassung", "werk", "standort", "buro", "filiale", "zweigstelle", "hauptsitz", "geschaftsstelle", "lager",
        ),
        "prepositions": ("in", "bei", "zu"),
    },
    "es": {
        "keywords": ("oficina", "sucursal", "sede", "planta", "fabrica", "almacen", "filial", "delegacion"),
        "prepositions": ("de", "en"),
    },
    "it": {
        "keywords": ("filiale", "sede", "ufficio", "stabilimento", "deposito", "magazzino", "sedi"),
        "prepositions": ("di", "a", "in"),
    },
    "pt": {
        "keywords": ("agencia", "escritorio", "filial", "fabrica", "armazem", "sucursal", "delegacao", "sede"),
        "prepositions": ("de", "do", "da", "em"),
    },
}
PLANT_LINKERS = (
    "a", "an", "au", "aux", "da", "das", "de", "degli", "dei", "del", "della", "delle", "den", "der", "des", "di", "die", "do", "dos", "du", "en",
    "in", "la", "le", "les", "of", "the", "vom", "von", "w", "à",
)
PLANT_NOISE = (
    "address", "and", "client", "code", "contact", "customer", "date", "destinataire", "email", "et", "expediteur", "facilities", "facility",
    "fax", "fournisseur", "list", "manufacturing", "name", "number", "or", "page", "phone", "production", "recipient", "section", "sender",
    "supplier", "title", "type",
)
PERSON_KEYWORDS_FR = (
    "correspondant", "contact", "suivi par", "affaire suivie", "demandeur", "acheteur", "vendeur", "rep:", "rep ", "a l'attention",
    "attention de", "responsable",
)
PERSON_KEYWORDS_DE = (
    "ansprechpartner", "kontakt", "bearbeiter", "zustandig", "verantwortlich", "mitarbeiter", "vertrieb", "verkaufer", "geschäftsführer",
    "geschaftsfuhrer", "vorstand", "vorsitzender", "aufsichtsrat", "aufsichtsrats", "prokurist", "direktor", "leiter", "leitung",
    "abteilungsleiter", "kundenbetreuer", "ihr berater",
)
PERSON_KEYWORDS_EN = (
    "contact", "attention", "addressed to", "regards", "salesperson", "representative", "rep:", "rep ", "account manager", "yours sincerely",
    "best regards", "from:", "to:",
)
PERSON_KEYWORDS_ES = (
    "contacto", "atencion", "atte", "atentamente", "responsable", "encargado", "vendedor", "comercial", "saludos cordiales", "de:", "para:",
)
PERSON_KEYWORDS_IT = (
    "contatto", "attenzione", "alla cortese attenzione", "responsabile", "incaricato", "commerciale", "venditore", "cordiali saluti", "da:",
    "a:", "rif:",
)
PERSON_KEYWORDS_PT = (
    "contato", "contacto", "atencao", "atencao de", "responsavel", "encarregado", "vendedor", "comercial", "atenciosamente", "cumprimentos",
    "de:", "para:",
)
PERSON_KEYWORDS_BG = (
    "контакт", "лице за връзка", "представител", "отговорник", "продавач", "купувач", "до:", "от:", "с уважение", "поздрави", "управител",
    "директор", "ръководител",
)
DE_NON_NAMES = (
    "abteilungsleiter", "amtsgericht", "an", "ansprechpartner", "auf", "aufsichtsrat", "aufsichtsrats", "bearbeiter", "das", "dem", "den", "der",
    "des", "deutschland", "die", "direktor", "frankreich", "geschaftsfuhrer", "geschäftsführer", "geschäftsführerin", "gesellschaft", "in",
    "kontakt", "kundenbetreuer", "leiter", "leitung", "mit", "mitarbeiter", "oder", "prokurist", "registergericht", "schweiz", "sitz", "und",
    "von", "vorsitzende", "vorsitzender", "vorstand", "zu", "österreich",
)
GROUP_STOPS = ("and", "aucun", "et", "ne", "nee", "non", "née", "oder", "or", "ou", "sont", "und", "yes")
MAIDEN_STOPS = (
    "am", "aout", "april", "august", "avril", "december", "decembre", "den", "der", "die", "el", "february", "fevrier", "in", "january",
    "janvier", "juillet", "juin", "july", "june", "la", "le", "les", "mai", "march", "mars", "may", "november", "novembre", "october", "octobre",
    "on", "septembre",
)
CELL_NOT_A_NAME = (
    "ACHATS", "ADV", "ALLEMAGNE", "BASIC", "BELGIQUE", "BRUT", "CHEQUE", "CHIMIE", "CONDITIONS", "CPT", "DAP", "DDP", "ESPAGNE", "EST", "EXW",
    "FACTURATION", "FALSE", "FAUX", "FCA", "FOB", "FRANCE", "HT", "HYGIENE", "INCOTERM", "INCOTERMS", "ITALIE", "LIVRAISON", "MADAME",
    "MADEMOISELLE", "MAINTENANCE", "MONSIEUR", "NA", "NET", "NIL", "NO", "NON", "NORD", "OUEST", "OUI", "PAIEMENT", "PREMIUM", "PRO",
    "PRODUCTION", "QUALITE", "REMISE", "STANDARD", "SUD", "TBA", "TBD", "TOTAL", "TRAITE", "TRUE", "TTC", "TVA", "VENTES", "VIREMENT", "VOID",
    "VRAI", "YES",
)
LEGAL_SUFFIXES = (
    "GmbH", "AG", "AKTIENGESELLSCHAFT", "Aktiengesellschaft", "KG", "OHG", "GbR", "KGaA", "SE", "SARL", "SAS", "SASU", "SA", "SCI", "EURL",
    "SCS", "SNC", "S.A.S", "S.A.R.L", "Ltd", "LLC", "Inc", "Corp", "PLC", "LLP", "LP", "Limited", "Incorporated", "Corporation", "S.A.", "S.L.",
    "S.A.U.", "SAU", "S.r.l.", "S.p.A.", "Snc", "Sas", "Lda.", "Lda", "S/A", "Unipessoal", "B.V.", "BV", "N.V.", "NV", "Holdings", "Holding",
    "Group", "Groupe", "Services", "Solutions", "Systems", "Industries", "Technologies", "International", "Consulting", "Partners",
    "Enterprises",
)
HEADER_ACRONYMS = (
    "C.G.A", "C.G.A.", "C.G.V", "C.G.V.", "E.U", "E.U.", "N.B", "N.B.", "P.J", "P.J.", "P.S", "P.S.", "R.C.S", "R.C.S.", "S.A", "S.A.",
    "S.A.R.L", "S.A.R.L.", "S.A.S", "S.A.S.", "T.V.A", "T.V.A.", "U.K", "U.K.", "U.S.A", "U.S.A.",
)
TECHNICAL_ACRONYMS = (
    "A", "AC", "AFNOR", "API", "ASCII", "ATEX", "BE", "BG", "BGA", "CE", "CH", "CHF", "CM", "CN", "CNY", "CSA", "CSV", "CZ", "DC", "DE", "DIN",
    "DIP", "EN", "ES", "ETI", "EU", "EUR", "FR", "FR-4", "FR4", "G", "GBP", "GST", "GmbH", "HP", "HT", "HZ", "I/O", "IECEx", "IO", "IP54", "IP55",
    "IP65", "IP66", "IP67", "IP68", "IP69", "ISO", "IT", "Inc", "JP", "JPY", "JSON", "KG", "KHZ", "KM", "KR", "KV", "KW", "L", "L/MIN", "LCD", "LED",
    "LLC", "Ltd", "M", "M3", "MA", "MAX", "MG", "MHZ", "MIN", "ML", "MM", "MV", "MW", "N", "NB", "NB.", "NEF", "NEUF", "NF", "NIL", "NL", "NPN",
    "OK", "OKAY", "OLED", "PCB", "PCBA", "PCE", "PCS", "PDF", "PL", "PLC", "PME", "PMI", "PNP", "PRO", "PT", "PWM", "QFN", "RAL", "REACH", "REF",
    "REF.", "RG", "RGB", "RMB", "RoHS", "SA", "SAR", "SARL", "SAS", "SAV", "SCH", "SMT", "STD", "STDARD", "SpA", "TFT", "TG", "TR", "TTC", "TVA",
    "UK", "UL", "US", "USA", "USB", "USB-3", "USB-A", "USB-C", "USB2", "USB3", "USD", "UTF", "V", "VAT", "W", "XML", "Y",
)
BANK_INLINE_STOPS = (
    "any", "at", "autre", "by", "das", "der", "die", "ein", "eine", "el", "every", "for", "from", "her", "his", "in", "la", "las", "le", "los",
    "nossa", "notre", "nuestra", "on", "otra", "our", "outra", "some", "the", "their", "this", "to", "vossa", "votre", "vuestra", "with", "your",
)
BANK_STOPS = ("a", "completar", "completer", "non", "renseigner", "see", "siehe", "todo", "voir", "à")
IBAN_LENGTHS = {
    "AD": 24,
    "AE": 23,
    "AT": 20,
    "BE": 16,
    "BG": 22,
    "CH": 21,
    "CY": 28,
    "CZ": 24,
    "DE": 22,
    "DK": 18,
    "EE": 20,
    "ES": 24,
    "FI": 18,
    "FR": 27,
    "GB": 22,
    "GR": 27,
    "HR": 21,
    "HU": 28,
    "IE": 22,
    "IS": 26,
    "IT": 27,
    "LI": 21,
    "LT": 20,
    "LU": 20,
    "LV": 21,
    "MC": 27,
    "MT": 31,
    "NL": 18,
    "NO": 15,
    "PL": 28,
    "PT": 25,
    "RO": 24,
    "SE": 24,
    "SI": 19,
    "SK": 24,
    "SM": 27,
    "TR": 26,
}
BIC_CONTEXT = (
    "BIC", "SWIFT", "B.I.C", "VIREMENT", "REGLEMENT", "RÈGLEMENT", "DOMICILIATION", "IBAN", "RIB",
)
IBAN_CONTEXT = (
    "IBAN", "I.B.A.N", "RIB", "R.I.B", "COMPTE", "ACCOUNT", "KONTO", "KONTONUMMER", "REFERENCE BANCAIRE", "REFERENCES BANCAIRES", "CUENTA",
    "CUENTA BANCARIA", "BANCO", "CONTO", "CONTO CORRENTE", "CONTA", "CONTA BANCARIA", "HESAP", "HESAP NUMARASI", "BANKA BILGILERI", "BANKA",
    "BANKOVNI SPOJENI", "BANKOVNÍ SPOJENÍ", "CISLO UCTU", "ČÍSLO ÚČTU", "UCET", "ÚČET", "银行账号", "银行账户", "账号", "账户", "开户行", "口座番号", "口座", "銀行口座",
    "振込先", "БАНКА", "СМЕТКА", "БАНКОВА СМЕТКА", "БАНКОВИ ДАННИ",
)
BIC_NOISE = (
    "ACOMPTE", "BORDEREAU", "BORDEREAUX", "COMPTABLE", "DELIVREE", "DELIVREES", "DOMICILE", "ETRANGER", "FACTURE", "FACTURES", "MATERIEL",
    "PROTOCOLE", "REFERENCE", "REFERENCES", "VIREMENT",
)
NOT_A_VALUE = (
    "client", "cm", "code", "commande", "date", "eur", "facture", "g", "gbp", "ht", "kg", "ko", "l", "livraison", "m", "ml", "mm", "n/a", "no",
    "non", "ok", "oui", "page", "qte", "qty", "ras", "remise", "tbd", "ttc", "tva", "type", "u", "usd", "yes",
)
POSTAL_CITY_STOPS = (
    "acompte", "bic", "commande", "contribution", "designation", "domiciliation", "emballage", "escompte", "eur", "euros", "facture", "forfait",
    "frais", "franco", "iban", "livraison", "minimum", "montant", "quantite", "reference", "remise", "rib", "swift", "total", "transport",
)
COMPANY_NOISE = (
    "account", "acheteur", "actions", "alinea", "amount", "and", "annual", "anonyme", "ape", "art", "article", "artikel", "auto", "autorise",
    "basic", "bestellung", "betrag", "billed", "billing", "bordereau", "buyer", "capital", "carrier", "central", "champ", "charge", "client",
    "commande", "compte", "conditions", "contractuelle", "customer", "de", "delegue", "delivered", "den", "der", "des", "designation",
    "destinataire", "direct", "discount", "donnees", "du", "echeance", "el", "encours", "engagement", "engagements", "entrepreneur", "et",
    "expediteur", "express", "externe", "facturation", "facture", "forfait", "fournisseur", "gateway", "general", "gerant", "gesamt", "gross",
    "ground", "hours", "ht", "include", "incoterm", "individuelle", "informations", "interlocuteur", "interne", "invoice", "issued", "issuer",
    "kbis", "konto", "kunde", "la", "las", "le", "legales", "les", "lieferant", "ligne", "lignes", "limitee", "livraison", "long", "los", "mail",
    "manager", "menge", "mentions", "modalites", "montant", "monthly", "naf", "name", "net", "objet", "of", "office", "or", "order", "page", "pages",
    "payment", "personnelles", "plan", "preis", "president", "presidente", "principal", "protection", "quantite", "rcs", "rechnung", "recipient",
    "reciproques", "reference", "regement", "regle", "reglement", "regles", "remise", "represente", "responsabilite", "responsable", "reverse",
    "seller", "sender", "service", "shipped", "shipping", "short", "simplifiee", "siren", "siret", "social", "somme", "sous-total", "speciale",
    "subject", "subtotal", "summe", "supplier", "tarification", "technicien", "title", "total", "totaux", "tracking", "transporteur", "ttc", "tva",
    "und", "value", "van", "vendeur", "vendor", "visite", "von",
)
COMPANY_PARTICLES = (
    "&", "and", "da", "das", "de", "des", "do", "dos", "du", "et", "la", "le", "les", "of", "und", "y",
)
PROPAGATED_TYPES = (
    "ADDRESS", "APE_CODE", "BIC", "CAPITAL", "CLIENT_CODE", "COMPANY", "EMAIL", "IBAN", "INTERNAL_REF", "LOCATION", "ORDER_REF", "ORG",
    "ORGANIZATION", "ORG_SINGLETON", "PERSON", "PHONE", "RIB", "SIREN", "SIRET", "TRACKING", "VAT",
)
TITLE_PREFIXES = (
    "monsieur", "madame", "mademoiselle", "mr.", "mrs.", "ms.", "m.", "mr", "mrs", "ms", "mme", "mlle", "sra.", "sr.", "sra", "sr", "sig.",
    "sig", "herr", "frau", "pan", "pani", "sayin", "dr.", "dr", "me", "г-н", "г-жа", "г-ца", "господин", "госпожа", "госпожица",
)
TITLE_SUFFIXES = ("先生", "女士", "小姐", "夫人", "様", "さん", "君", "殿", "ちゃん", "氏", "サン")
TOKEN_STOPS = (
    "acheteur", "agency", "agreement", "amount", "and", "bank", "bestellung", "born", "branch", "buyer", "class", "client", "code", "column",
    "commande", "contract", "contrat", "customer", "da", "das", "date", "de", "delivery", "den", "der", "des", "designation", "destinataire", "di",
    "do", "dos", "du", "désignation", "el", "et", "expediteur", "facture", "fournisseur", "freight", "hour", "interlocuteur", "invoice", "item",
    "kaufer", "kunde", "la", "las", "le", "les", "level", "lieferant", "line", "loading", "los", "manufacturer", "montant", "name", "ne", "nee",
    "number", "numero", "numéro", "née", "of", "office", "order", "page", "partie", "parties", "party", "pickup", "place", "point", "price",
    "purchase", "quantite", "quantity", "quantité", "receiving", "rechnung", "reference", "remise", "responsable", "row", "référence", "seller",
    "sending", "service", "shipping", "signataire", "supplier", "ten", "ter", "the", "time", "title", "total", "transport", "transporteur", "type",
    "und", "unit", "unite", "unité", "unloading", "value", "van", "vendeur", "vendor", "verkaufer", "von", "y", "zum", "zur",
)
LEGAL_TOKENS = (
    "AB", "AG", "AKTIENGESELLSCHAFT", "AS", "BV", "BVBA", "CO", "CORP", "EG", "EI", "EIRL", "EURL", "EV", "GBR", "GESELLSCHAFT", "GMBH", "INC", "KG",
    "LDA", "LLC", "LLP", "LTD", "MBH", "NV", "OHG", "OY", "PLC", "S.A", "S.A.R.L", "S.A.S", "S.A.S.U", "SA", "SAPA", "SARL", "SARLU", "SAS", "SASU",
    "SCA", "SCI", "SCOP", "SCP", "SCRI", "SCRL", "SCS", "SELARL", "SELAS", "SNC", "SNS", "SP", "SPA", "SPRL", "SPRLU", "SRL", "VOF",
)
HEADER_ABBREVIATIONS = (
    "anz", "art", "mng", "mt", "n", "no", "n°", "p.u", "pos", "position", "pu", "qtd", "qte", "qtite", "qtité", "qty", "qté", "ref", "réf",
    "surcout", "surcoût", "um", "un", "uq",
)
TOTAL_TERMS = (
    "a payer", "amount", "endbetrag", "gesamt", "gesamtbetrag", "gesamtsumme", "grand total", "importe", "montant", "rechnungsbetrag", "somme",
    "sous-total", "subtotal", "summe", "total", "total amount", "totale", "totaux", "valor total", "zwischensumme",
)
FOOTER_MARKERS = (
    "code ape", "code naf", "conditions de livraison", "conditions de paiement", "conditions generales", "gerichtsstand", "incoterm",
    "incoterms", "lieferbedingungen", "payment terms", "reglement", "sanctions", "siret", "terms and conditions", "zahlungsbedingungen",
)
CRITICAL_TAGS = (
    "AddressFragmentRegex", "AffairNumberRegex", "ApeCodeRegex", "AutomotiveOemDict", "BankAccountByContextRegex", "BankByContextRegex",
    "BgEgnRegex", "BgEikRegex", "BgHealthInsuranceRegex", "BgIdCardRegex", "BgLnchRegex", "BicRegex", "CapitalRegex", "ClientCodeRegex",
    "CnHkidRegex", "CnIdRegex", "CnPassportRegex", "CnUsccRegex", "CommercialCellRegex", "CompactDateRegex", "CompanyHeaderRegex", "CzCsszRegex",
    "CzDicRegex", "CzIcoRegex", "CzOpRegex", "CzRodneCisloRegex", "DateOfBirthRegex", "DeHandelsregisterRegex", "DeNationalIdRegex",
    "EmailRegex", "EntityPropagation", "EnumeratedNamesRegex", "EsCccRegex", "EsCifRegex", "EsDniRegex", "EsNieRegex", "HmrcRefRegex",
    "IbanRegex", "InternalRefRegex", "ItCodiceFiscaleRegex", "ItCodiceSdiRegex", "ItRegulatoryRegex", "ItTesseraSanitariaRegex",
    "JpDriverLicenceRegex", "JpHealthInsuranceRegex", "JpHojinBangoRegex", "JpMaiNumberRegex", "JpPassportRegex", "JpToukiBangouRegex",
    "KrBusinessRegistrationRegex", "KrRrnRegex", "MaidenNameRegex", "NationalIdRegex", "OrderRefByContextRegex", "OrgLineExpansion",
    "OrgSingleton", "OrgSingletonLoose", "OrgStructureRegex", "OrgSuffixRegex", "OrganizationsDenyList", "OrganizationsLooseDenyList",
    "ParenContentRegex", "PeopleDenyList", "PersonLineExpansion", "PlKrsRegex", "PlNipRegex", "PlPeselRegex", "PlRegonRegex", "PlantCodeRegex",
    "PostalEuRegex", "PtCcRegex", "PtNifRegex", "PtNissRegex", "RibFrFieldsRegex", "RibFrRegex", "SirenRegex", "SiretRegex",
    "SocialSecurityFrRegex", "TableColumnsRegex", "TrSgkRegex", "TrSicilRegex", "TrTcknRegex", "TrVknRegex", "TrackingRegex",
    "UkDrivingLicenceRegex", "UkNiNumberRegex", "UkUtrRegex", "UrssafRegex", "VatFrRegex",
)
PHONE_TAGS = (
    "PhoneBeRegex", "PhoneBrRegex", "PhoneDeRegex", "PhoneEsRegex", "PhoneFrRegex", "PhoneInternationalRegex", "PhoneItRegex", "PhoneLatamRegex",
    "PhoneOceRegex", "PhonePtRegex", "PhoneUkRegex", "PhoneUsRegex",
)
EXEMPT_TAGS = (
    "AddressFragmentRegex", "AffairNumberRegex", "ApeCodeRegex", "AutomotiveOemDict", "BankAccountByContextRegex", "BgEgnRegex", "BgEikRegex",
    "BgHealthInsuranceRegex", "BgIdCardRegex", "BgLnchRegex", "BicRegex", "CapitalRegex", "ClientCodeRegex", "CnHkidRegex", "CnIdRegex",
    "CnPassportRegex", "CnUsccRegex", "CommercialCellRegex", "CompactDateRegex", "CzCsszRegex", "CzDicRegex", "CzIcoRegex", "CzOpRegex",
    "CzRodneCisloRegex", "DateOfBirthRegex", "DeHandelsregisterRegex", "DeNationalIdRegex", "EmailRegex", "EsCccRegex", "EsCifRegex",
    "EsDniRegex", "EsNieRegex", "HmrcRefRegex", "IbanRegex", "InternalRefRegex", "ItCodiceFiscaleRegex", "ItCodiceSdiRegex", "ItRegulatoryRegex",
    "ItTesseraSanitariaRegex", "JpDriverLicenceRegex", "JpHealthInsuranceRegex", "JpHojinBangoRegex", "JpMaiNumberRegex", "JpPassportRegex",
    "JpToukiBangouRegex", "KrBusinessRegistrationRegex", "KrRrnRegex", "MaidenNameRegex", "NationalIdRegex", "OrderRefByContextRegex",
    "OrgSingleton", "OrgSingletonLoose", "OrgStructureRegex", "OrgSuffixRegex", "OrganizationsDenyList", "OrganizationsLooseDenyList",
    "ParenContentRegex", "PeopleDenyList", "PhoneBeRegex", "PhoneInternationalRegex", "PhoneOceRegex", "PhoneUkRegex", "PlKrsRegex",
    "PlNipRegex", "PlPeselRegex", "PlRegonRegex", "PlantCodeRegex", "PostalEuRegex", "PtCcRegex", "PtNifRegex", "PtNissRegex",
    "RibFrFieldsRegex", "RibFrRegex", "SirenRegex", "SiretRegex", "SocialSecurityFrRegex", "TableColumnsRegex", "TrSgkRegex", "TrSicilRegex",
    "TrTcknRegex", "TrVknRegex", "TrackingRegex", "UkDrivingLicenceRegex", "UkNiNumberRegex", "UkUtrRegex", "UrlRegex", "UrssafRegex",
    "VatFrRegex",
)
PLACEHOLDER_PREFIX = {
    "ORG_SINGLETON": "CLIENT_NAME",
    "ORGANIZATION": "SUPPLIER",
    "PERSON": "CONTACT",
    "LOCATION": "ADDRESS",
    "ADDRESS": "ADDRESS",
    "EMAIL": "EMAIL",
    "PHONE": "PHONE",
    "URL": "URL",
    "SIRET": "SIRET",
    "SIREN": "SIREN",
    "VAT": "VAT",
    "APE_CODE": "APE",
    "CAPITAL": "CAPITAL",
    "RIB": "RIB",
    "IBAN": "IBAN",
    "BIC": "BIC",
    "NATIONAL_ID": "NATID",
    "DATE_OF_BIRTH": "DOB",
    "NRP": "NRP",
    "ORDER_REF": "CLIENT_ORDER_REF",
    "CLIENT_CODE": "CLIENT_CODE",
    "AFFAIR_NUMBER": "CLIENT_AFFAIR_REF",
    "INTERNAL_REF": "REF",
    "TRACKING": "TRACKING",
    "ORG_STRUCTURE": "SERVICE",
    "COMMENT": "COMMENT",
    "DATE": "DATE",
}
BARE_TYPES = r'ORG|SUPPLIER_\d+|PERSON_\d+|EMAIL_\d+|PHONE_\d+|ADDR_\d+|LOCATION_\d+|SIREN_\d+|SIRET_\d+|VAT_\d+|IBAN_\d+|BIC_\d+|URL_\d+|ORG_\d+|NRP_\d+'
HTML_COLORS = {
    "PERSON": "#FFB3BA",
    "EMAIL": "#BFFCC6",
    "PHONE": "#BAE1FF",
    "ORGANIZATION": "#FFFFBA",
    "ORG_SINGLETON": "#FFDFBA",
    "LOCATION": "#E0BBE4",
    "URL": "#D0F4DE",
    "IBAN": "#A0C4FF",
    "BIC": "#A0C4FF",
    "SIRET": "#FFD6A5",
    "SIREN": "#FFD6A5",
    "VAT": "#FFD6A5",
}
ACCENT_CLASSES = {
    "a": "[aàáâäãåAÀÁÂÄÃÅ]",
    "e": "[eéèêëEÉÈÊË]",
    "i": "[iíìîïIÍÌÎÏ]",
    "o": "[oóòôöõOÓÒÔÖÕ]",
    "u": "[uúùûüUÚÙÛÜ]",
    "c": "[cçCÇ]",
    "n": "[nñNÑ]",
    "y": "[yýÿYÝŸ]",
}
STRONG_MARKERS = {
    "de": (
        r'\bDeutschland\b', r'\bÖsterreich\b', r'\bGeschäftsführer\b', r'\bSitz der Gesellschaft\b', r'\bRegistergericht\b', r'\bAufsichtsrat\w*\b',
    ),
    "en": (r'\bUnited Kingdom\b', r'\bUnited States\b'),
    "es": (r'\bEspaña\b',),
    "it": (r'\bItalia\b',),
    "pt": (r'\bPortugal\b', r'\bBrasil\b'),
    "fr": (r'\bFrance\b',),
    "bg": (r'\bБългария\b', r'\bРепублика\s+България\b', r'\bТърговски\s+регистър\b'),
}
WEAK_MARKERS = {
    "de": (
        r'\bGmbH\b', r'\bAG\b', r'\bKG\b', r'\bSE\b', r'\bVorstand\b', r'\bAmtsgericht\b', r'\bUST-IdNr\.\b', r'\bUSt-IdNr\.\b', r'\bSchweiz\b',
    ),
    "en": (
        r'\bLtd\.?\b', r'\bLLC\b', r'\bInc\.\b', r'\bCorp\.\b', r'\bPLC\b', r'\bSincerely\b', r'\bRegards\b',
    ),
    "es": (r'\bS\.A\.\b', r'\bSociedad Anonima\b', r'\bSL\b', r'\bAtentamente\b'),
    "it": (r'\bS\.r\.l\.\b', r'\bS\.p\.A\.\b', r'\bCordiali saluti\b'),
    "pt": (r'\bLda\.?\b', r'\bSociedade\b', r'\bAvenida\b', r'\bAv\.\s*\d', r'\bRua\b', r'\bCNPJ\b'),
    "fr": (
        r'\bSARL\b', r'\bSAS\b', r'\bS\.A\.S\.\b', r'\bSASU\b', r'\bcordialement\b', r'\bSiège social\b',
    ),
    "bg": (
        r'\bООД\b', r'\bЕООД\b', r'\bАД\b', r'\bЕАД\b', r'\bС\s+уважение\b', r'\bЗдравейте\b', r'\bлв\.?\b', r'\bДДС\b', r'\bфактура\b',
    ),
}
NAME_PART = r"[A-ZÄÖÜÉÈÀÂÊÎÔÛÇÑ][A-Za-zäöüéèàâêîôûçñÄÖÜÉÈÀÂÊÎÔÛÇÑ&\-'.]{1,30}"
GROUP_NAME = r"[A-ZÀ-Ý][A-Za-zÀ-ÿ\-'’]{2,}"
PRICE = r'(?<![.,\d])\d+[.,]\d{2}(?![.,\d])'
LONG_NUMBER = r'\d{6,}'
QUANTITY = r'(?i)\b\d{1,4}(?:[.,]\d{1,3})?[ \xa0]?(?:pce|pcs|pc|un|ea|st|stk|stck|stuck|pz|kg|m|ml|l|pr|box|set|m2|m3)\b'
VAT_LINE = r'\bFR\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{3}\b'
CONTACT_LINE = r'(?i)@|www\.|https?://'
PHONE_FORMATTED = r'[+()]|\d[ .\-]\d'
PHONE_LABEL = r'(?ui)(?:\bT[ée]l(?:[ée]phone)?\b|\bPhone\b|\bFax\b|\bMobile\b|\bGSM\b|\bMob\.?|\bTel\.?|\bTelefon\b|\bTelefax\b|\bMobiltelefon\b|\bTel[ée]fono\b|\bTlf\b|\bTel[ée]fone\b|\bM[óo]vil\b|\bCelular\b|\bTelefono\b|\bCellulare\b|\bTelefon\b|\bKom\.?|\bKomórka\b|\bTelefonu?\b|\bCep\b|\bTelefon\b|\bMobil\b|电话|電話|传真|傳真|手机|手機|FAX|携帯|\bтел\.?|\bтелефон\b|\bфакс\b|\bмоб\.?)\s*[.:：]?\s*\(?$'
LEGAL_BOUNDARY = r'(?i)\b(?:S\.?A\.?R\.?L\.?|S\.?A\.?S\.?(?:U)?|S\.?A\.?|SNC|SARL|SAS|EURL|EIRL|GmbH|AG|Ltd|LLC|Inc|Corp|SpA|Srl|BV|NV|Lda|Lda\.?|au\s+capital|capital(?:\s+social)?|SIREN|SIRET|RCS|incoterm|TVA|VAT|N°)\b'
COMMERCIAL_TOKEN = r"\b(?:[A-Z][A-Za-zÀ-ÿ0-9\-’']{2,}|[A-Z]{2,}[0-9]{1,4}|[A-Z](?:\.[A-Z]){1,5}\.?)\b"
PERSON_TOKEN = r"\b(?:[A-ZÀ-Ý][A-Za-zÀ-ÿ\-'’]{1,30}|[A-ZÀ-Ý]{2,30})\b"
PERSON_BOUNDARY = r'(?i)\b(?:S\.?A\.?R\.?L\.?|S\.?A\.?S\.?(?:U)?|S\.?A\.?|SNC|SARL|SAS|EURL|EIRL|GmbH|AG|Ltd|LLC|Inc|Corp|SpA|Srl|BV|NV|Lda|au\s+capital|capital(?:\s+social)?|SIREN|SIRET|RCS|incoterm|TVA|VAT|N°)\b'
PLACEHOLDER = r'\[([A-Z][A-Z_]*(?:_[A-Za-z0-9]+)?)\]'
PLACEHOLDER_BARE = r'^(ORG|SUPPLIER_\d+|PERSON_\d+|EMAIL_\d+|PHONE_\d+|ADDR_\d+|LOCATION_\d+|SIREN_\d+|SIRET_\d+|VAT_\d+|IBAN_\d+|BIC_\d+|URL_\d+|ORG_\d+|NRP_\d+)$'
PLACEHOLDER_BARE_INLINE = r'\b(ORG|SUPPLIER_\d+|PERSON_\d+|EMAIL_\d+|PHONE_\d+|ADDR_\d+|LOCATION_\d+|SIREN_\d+|SIRET_\d+|VAT_\d+|IBAN_\d+|BIC_\d+|URL_\d+|ORG_\d+|NRP_\d+)\b'
TRAILING_LETTER = r'(\[[A-Z_]+(?:_\d+)?\])\s+([A-Z])(?=[\s,;:\)\]\.])'
ADJACENT_LETTER = r'(\[[A-Z_]+(?:_\d+)?\])([A-Z])(?=\s|$|[^A-Za-z])'
BOM = "^﻿"
SPACES = r'[ \t]{2,}'
ODD_SPACE = r'[^\S\n\r\t\f\v]'
PIPE_NOISE = r'([A-Za-z]) \| ([A-Za-z])'
