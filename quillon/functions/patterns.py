"""Patterns of the detectors: fixed values.

They must equal the published rules for right results, so they stand here as text, by family, in the syntax of Python's `re`;
`quillon.functions.regex` turns them into Java syntax. `(?P<value>...)` marks the part of a match that is kept.
"""

PATTERNS = {
    "email": r"""\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+(?:\n[a-zA-Z0-9.\-]+)?\.[a-zA-Z]{2,}\b""",
    "url": r"""(?i)\b(?:(?:https?://|www\.)[a-zA-Z0-9][a-zA-Z0-9\-]{0,62}(?:\.[a-zA-Z0-9\-]{2,})+|[a-zA-Z0-9][a-zA-Z0-9\-]{2,62}\.(?:com|org|net|info|biz|edu|gov|mil|int|app|tech|ai|io|co|me|tv|cc|name|pro|aero|coop|jobs|mobi|asia|cat|fr|eu|de|es|it|pt|nl|be|ch|pl|tr|uk|cz|at|se|no|dk|fi|gr|hu|ie|lu|ro|bg|sk|si|lt|lv|ee|hr|is|mt|cy|li|mc|sm|va|al|ba|mk|me|rs|md|us|ca|mx|br|ar|cl|co|pe|ve|uy|py|bo|ec|jp|cn|kr|tw|hk|sg|in|id|th|my|ph|vn|pk|bd|lk|ae|sa|il|au|nz|za|eg|ma|tn|ng|ke|gh|ci|sn|ru|ua|by|kz))(?![^\W\d_])(?:/[^\s]*)?""",
    "phone_fr": r"""(?<!\d)(?:\+[ \t.\-]?33[ \t.\-]?(?:\(0\)[ \t.\-]?)?0?[ \t.\-]?|00[ \t.\-]?33[ \t.\-]?(?:\(0\)[ \t.\-]?)?0?[ \t.\-]?|33[ \t.\-]?\(0\)[ \t.\-]?|0[ \t.\-]?)[1-9](?:[ \t.\-]?\d){8}(?!\d)""",
    "phone_fr_labelled": r"""(?ui)(?:\bT[ée]l(?:[ée]phone)?\b|\bPhone\b|\bFax\b|\bMobile\b|\bGSM\b|\bMob\.?|\bTel\.?|\bTelefon\b|\bTelefono\b|\bTel[ée]fono\b|\bTel[ée]fone\b|\bM[óo]vil\b|\bTlf\b|\bCellulare\b|\bCelular\b|\bMobil\b|\bKom\.?|电话|電話|传真|傳真|手机|手機|FAX|携帯|\bтел\.?|\bтелефон\b|\bфакс\b)\s*[.:：]?\s*(?<!\d)(?P<value>[1-9]\d{8})(?!\d)""",
    "phone_be": r"""(?<!\d)(?:\+[\s.\-]?32[\s.\-]?(?:\(0\)[\s.\-]?)?|00[\s.\-]?32[\s.\-]?(?:\(0\)[\s.\-]?)?|\(\+?32\)[\s.\-]?(?:\(0\)[\s.\-]?)?)[1-9](?:[\s.\-]?\d){7,8}(?!\d)""",
    "phone_de": r"""(?<![\w])(?:\+(?:49|43|41)|0)[\s\-/.()]*\(?[0]?\d{2,5}\)?[\s\-/.]+\d{2,4}[\s\-/.]?\d{2,8}(?![\w])""",
    "phone_uk": r"""(?<!\d)\+\s?44[\s\-.]?(?:\(0\)[\s\-.]?)?\d(?:[\s\-.\n]?\d){9}(?!\d)""",
    "phone_us": r"""(?<![\w])(?:\+1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}(?![\w])""",
    "phone_oce": r"""(?<![\w])\+(?:61|353|64)\s?\d{1,4}[\s\-]?\d{3,4}[\s\-]?\d{3,4}(?![\w])""",
    "phone_es": r"""(?<![\w])(?:\+34\s?)?[6789]\d{2}[\s\-]?\d{2,3}[\s\-]?\d{2,3}[\s\-]?\d{0,2}(?![\w])""",
    "phone_latam": r"""(?<![\w])\+(?:52|54|55|56|57|58|51)\s?\d{1,3}[\s\-]?\d{3,4}[\s\-]?\d{3,4}(?![\w])""",
    "phone_it": r"""(?<![\w])(?:\+39\s?)?0?\d{1,4}[\s\-./]?\d{3,4}[\s\-./]?\d{3,5}(?![\w])""",
    "phone_pt": r"""(?<![\w])(?:\+351\s?[239]\d{1,2}\s?\d{3}\s?\d{3,4}|[239]\d{1,2}[\s.\-]\d{3,4}[\s.\-]\d{3,4})(?![\w])""",
    "phone_br": r"""(?<![\w])\+55\s?\(?\d{2}\)?[\s\-]?9?\d{4}[\s\-]?\d{4}(?![\w])""",
    "phone_international": r"""(?<!\d)\+\s?(?:351|352|353|354|356|357|358|359|370|371|372|373|374|375|376|377|378|380|381|382|383|385|386|387|389|420|421|423|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98|1|7)[\s\-.()\n]{0,3}(?:\(0\)[\s\-.]?)?[1-9](?:[\s\-.()\n]?\d){5,13}(?!\d)""",
    "iban_start": r"""[A-Z]{2}[ \t]?\d{2}""",
    "bic": r"""(?<![A-Z0-9])[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?(?![A-Z0-9])""",
    "rib_label": r"""(?i)(?<![A-Za-z])RIB(?![A-Za-z])""",
    "rib_structured": r"""(?<!\d)(?P<rib>\d{5}[\s\-./]{1,3}\d{5}[\s\-./]{1,3}[\dA-Z]{11}[\s\-./]{1,3}\d{2}|\d{5}[\s\-./]{1,3}\d{5}[\s\-./]{1,3}\d{3}[\s\-./]\d{8}[\s\-./]{1,3}\d{2})(?!\d)""",
    "rib_field": r"""(?i)(?:code\s+banque|code\s+guichet|n[°o]?\s*(?:de\s+)?compte|cl[ée]\s*rib)\s*:?\s*(\d(?:[\d ]*\d)?)""",
    "siret": r"""\b\d{3}[\s.\-]?\d{3}[\s.\-]?\d{3}[\s.\-]?\d{5}\b""",
    "siren": r"""(?<!\d)\d{3}[\s.\-]?\d{3}[\s.\-]?\d{3}(?!\d)""",
    "vat_fr": r"""\bFR\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{3}\b""",
    "fiscal_labelled": r"""(?i:Num[ée]ro\s+de\s+TVA|N[°o]\s*(?:de\s+)?TVA(?:\s*intra\w*\.?)?|VAT\s+(?:registration\s+)?(?:number|no\.?|reg\.?)|VAT|USt[-\s]?IdNr\.?|Partita\s+IVA|P\.?\s?IVA|EORI|NIP|N\.?I\.?F\.?|C\.?I\.?F\.?|N[úu]mero\s+de\s+contribuinte|Codice\s+fiscale|Steuernummer|Vergi\s+kimlik\s+numaras[ıi]|Vergi\s+(?:numaras[ıi]|no\.?)|VKN|Tax\s+(?:identification\s+)?(?:number|id\.?)|纳税人识别号|统一社会信用代码|税号|ДДС\s*(?:№|номер|No\.?|N\.?)?)[ \t:#：]*([A-Z]{0,3}[- ]?\d(?:[\dA-Z]|[ .\-/]\d){7,22})""",
    "ape": r"""(?i)(?:APE|NAF|Code\s+(?:APE|NAF))\s*[:.\-/]?\s*(?P<value>\d{4}\s?[A-Z])(?!\d)""",
    "ape_orphan": r"""(?<![A-Z0-9])(?P<value>\d{4}\s?[A-Z])(?![A-Z0-9])""",
    "ape_context": r"""(?i)\b(?:SIRET|SIREN|RCS|N\.?\s*APE|N\.?\s*NAF|TVA\s+intracom)""",
    "capital": r"""(?ui)(?:au\s+capital(?:\s+social)?(?:\s+de)?|capital(?:\s+social)?(?:\s+de)?|(?:share\s+capital|company\s+capital)(?:\s+of)?|Stamm-?kapital(?:\s+von)?|Grundkapital(?:\s+von)?|capitale\s+sociale(?:\s+di)?|kapita[łl]\s+(?:zak[łl]adowy|sp[óo][łl]ki)|z[áa]kladn[íi]\s+kapit[áa]l|sermayesi|kuruluş\s+sermayesi)[^A-Za-z\d]{0,30}(?P<value>\d{1,3}(?:[ \t.,]\d{3})+(?:[,.]\d{1,2})?|\d{4,}(?:[,.]\d{1,2})?)\s*(?:€|EUR(?:OS?)?|euros?|EURO?|PLN|CZK|TL)?""",
    "weee": r"""(?i)WEEE[-\s]*(?:Reg\.?[-\s]*Nr\.?)?\s*[:.]?\s*(?P<value>[A-Z]{2}\s?\d{6,10})""",
    "bank_label": r"""(?:^|\n)\s*(?:Banque|Banco|Bank|Banca|Bancaria|Domiciliation\s+bancaire|Domiciliation|Coordonn[ée]es\s+bancaires|Dados\s+banc[áa]rios|Datos\s+bancarios|Detalhes\s+banc[áa]rios|Detalles\s+bancarios|Dati\s+bancari|Coordinate\s+bancarie|Bankverbindung|Bankdaten|Banka(?:\s+Bilgileri)?|Hesap(?:\s+Bilgileri)?|Bankovn[íi]\s+spojen[íi]|[ČC][íi]slo\s+[úu][čc]tu|[ÚU][čc]et|开户行|银行账户|银行账号|账户名|账户|振込先|銀行口座|口座番号|[Бб]анка|[Бб]анкова\s+сметка|[Бб]анкови\s+данни|[Сс]метка)\s*[:\-]\s*(?P<bank>[A-ZÉÈÀÂÊÎÔÛÇ][\wÀ-ÿ\-'’\.]*(?:\s+(?:(?:de|du|des|la|le|les|et|à|au|aux|d[’'])|[A-ZÉÈÀÂÊÎÔÛÇ][\wÀ-ÿ\-'’\.]*|&)){1,8})""",
    "bank_inline": r"""(?<![A-Za-z])(?P<bank>(?:[A-Z][A-Za-zÀ-ÿ\-]+\s+){1,2}(?:Banco|Banca|Bank|Banque|Banka|Bankas[ıi]|银行|銀行)|(?:Banco|Banca|Bank|Banque|Banka|Bankas[ıi]|银行|銀行)(?:\s+[A-Z][A-Za-zÀ-ÿ\-]+){1,3})(?![A-Za-z])""",
    "bank_inline_cjk": r"""(?P<bank>[一-鿿ぁ-ゖァ-ヺA-Z0-9]{1,8}(?:银行|銀行))""",
    "postal_city_bg": r"""\b\d{4}[ \t]+[А-Я][Ѐ-ӿ \t\-'.]{2,60}""",
    "street_bg": r"""(?:ул\.|бул\.|пл\.|ж\.к\.|жк\.|кв\.|бл\.|гр\.|с\.|общ\.)\s*[А-Яа-я\d][Ѐ-ӿ\d \t\-'.,№]{2,80}""",
    "apartment_bg": r"""(?:ет\.|вх\.|ап\.)\s*\d+(?:[\s,]*(?:ет\.|вх\.|ап\.)\s*\d+){0,2}""",
    "postal_city_de": r"""\b(?:[A-Z]-)?\d{4,5}[ \t]+[A-ZÄÖÜ][A-Za-zäöüÄÖÜß \t\-'.]{2,60}""",
    "street_de": r"""(?i)\b[A-ZÄÖÜ][A-Za-zäöüÄÖÜß\-]{2,40}(?:strasse|straße|str\.|platz|weg|allee|gasse|ring|damm|ufer)(?:\s+\d{1,4}[a-z]?)?""",
    "postfach_de": r"""(?i)\bPostfach\s+\d{2,6}(?:\s+\d{1,3})?""",
    "zone_de": r"""(?:(?i:\b(?:Gewerbegebiet|Industriegebiet|Industriepark|Gewerbepark|Wirtschaftspark|Technologiepark))[ \t]+[A-ZÄÖÜ][\w \t\-'’/.]{2,60})""",
    "building_de": r"""(?:(?:[A-ZÄÖÜ][a-zäöüß]{3,20}[ \t]*-[ \t]*)?(?i:\b(?:Geb[äa]ude|Geb\.|Haus|Turm|Hochhaus|B[üu]ro(?:gebäude|geb\.)?|Bürohaus|Werk|Halle))[ \t]+[A-ZÄÖÜ][\w \t\-'’/.]{1,60})""",
    "postcode_uk": r"""\b[A-Z]{1,2}\d[A-Z\d]?[ ]\d[A-Z]{2}\b""",
    "zip_us": r"""\b\d{5}(?:-\d{4})?\b(?!\s*\d)""",
    "postcode_ca": r"""\b[A-Z]\d[A-Z][ ]?\d[A-Z]\d\b""",
    "street_en": r"""(?i)\b\d{1,5}[a-z]?\s+(?:[A-Z][A-Za-z\-']+\s+){1,3}(?:Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Road|Rd|Lane|Ln|Way|Court|Ct|Square|Sq|Place|Pl|Parkway|Pkwy|Terrace|Ter|Highway|Hwy|Crescent|Cres)\b\.?""",
    "po_box": r"""(?i)\b(?:P\.?\s?O\.?\s?Box|Post\s?Office\s?Box)\s+\d{1,6}\b""",
    "zone_en": r"""(?:(?i:\b(?:Business[ \t]Park|Industrial[ \t](?:Estate|Park|Zone)|Trading[ \t]Estate|Technology[ \t]Park|Science[ \t]Park|Office[ \t]Park|Retail[ \t]Park|Enterprise[ \t](?:Park|Zone)))[ \t]+[A-Z][\w \t\-'’/.]{2,60})|(?:\b[A-Z][A-Za-z\-']{2,30}(?:[ \t][A-Z][A-Za-z\-']+){0,2}[ \t](?i:Business[ \t]Park|Industrial[ \t]Estate|Trading[ \t]Estate|Technology[ \t]Park|Science[ \t]Park))""",
    "building_en": r"""(?:(?:[A-Z][a-z]{3,20}[ \t]*-[ \t]*)?(?i:\b(?:Building|Bldg|Tower|House|Block|Wing|Suite|Plaza|Centre|Center|Hall|Pavilion))[ \t]+[A-Z0-9][\w \t\-'’/.]{1,60})|(?:\b[A-Z][A-Za-z\-']{2,30}(?:[ \t][A-Z][A-Za-z\-']+){0,2}[ \t](?i:Tower|House|Building|Plaza|Centre|Center))""",
    "postal_city_es": r"""\b\d{5}[ \t]+[A-ZÁÉÍÓÚÑ][A-Za-zàáéíóúñÁÉÍÓÚÑ \t\-'.]{2,60}""",
    "street_es": r"""(?i)\b(?:C/|Calle|Avenida|Avda|Avd|Plaza|Pza|Paseo|Po|Carretera|Ctra|Camino|Cmno|Ronda|Travesia|Glorieta|Plazoleta)\s+(?:de\s|del\s|la\s|las\s|los\s|el\s)?[\w][\w \t\-'.]{2,60}""",
    "apartado_es": r"""(?i)\b(?:Apartado(?:\s+de\s+Correos)?|Apdo)\s+\d{1,6}\b""",
    "zone_es": r"""(?:(?i:\b(?:Pol[ií]gono[ \t]Industrial|Parque[ \t]Empresarial|Parque[ \t]Tecnol[óo]gico|Parque[ \t]Industrial|Zona[ \t]Industrial|Centro[ \t]Empresarial))[ \t]+(?:de[ \t]+|del[ \t]+|de[ \t]la[ \t]+)?[A-ZÁÉÍÓÚÑ][\w \t\-'’/.]{2,60})""",
    "building_es": r"""(?:(?:[A-ZÁÉÍÓÚÑ][a-záéíóúñ]{3,20}[ \t]*-[ \t]*)?(?i:\b(?:Edificio|Edif\.|Torre|Bloque|Pabell[óo]n|Nave|Manzana))[ \t]+[A-ZÁÉÍÓÚÑ0-9][\w \t\-'’/.]{1,60})""",
    "postal_city_fr": r"""\b\d{5}[ \t]*[A-Z][A-Za-zéèêëàâäîïôöùûüçÉÈÊËÀÂÄÎÏÔÖÙÛÜÇ \t\-'.]{2,60}\b""",
    "postal_code_fr": r"""(?<![\w./,€-])\b(?P<cp>[0-9]{5})\b(?![\w./,€-])""",
    "address_context": r"""(?i)\b(?:FRANCE|FRANCAIS|CEDEX|C[ée]dex|RUE|BOULEVARD|AVENUE|IMPASSE|ALL[ÉE]E|CHEMIN|ROUTE|PLACE|QUAI|COURS|BD|BLD|BLVD|AV|PARC\s+D['’]?ACTIVITE|Z\.?\s?I\.?|Z\.?\s?A\.?C?\.?|ZONE\s+INDUSTRIELLE|B\.?P\.?\s*\d|C\.?S\.?\s*\d|BO[ÎI]TE\s+POSTALE|SIRET|SIREN|R\.?C\.?S\.?|N°\s*TVA|APE|NAF)\b""",
    "bp": r"""(?i)\b(?:B\.?P\.?|C\.?S\.?)[ \t\-]*\d{2,6}\b""",
    "zone_fr": r"""(?:(?i:\b(?:PARC[ \t]D['’ ]ACTIVIT[EÉé]?[Ss]?|PARC[ \t]ACTIVIT[EÉé]?[Ss]?|Z\.?\s?A\.?\s?C\.?|Z\.?\s?A\.?|Z\.?\s?I\.?|ZONE[ \t]INDUSTRIELLE|ZONE[ \t]ARTISANALE|ZONE[ \t]D['’ ]ACTIVIT[EÉé]?[Ss]?|TECHNOPOLE|TECHNOPARC))[ \t]*-?[ \t]*(?i:de[ \t]+|du[ \t]+|des[ \t]+|d['’][ \t]*)?[A-ZÀ-Ý\d][\w \t\-'’/.]{2,80})|(?:(?:[A-ZÀ-Ý][a-zéèàâäîïôöùûüç]{3,20}[ \t]*-[ \t]*)?(?i:\b(?:IMMEUBLE|Imm\.|B[âa]TIMENT|B[âa]T\.?|TOUR|R[ée]SIDENCE|VILLA|PAVILLON|ARBORETUM))[ \t]+[A-ZÀ-Ý][\w \t\-'’/.]{1,60})|(?:\b[A-Z][A-Za-zéèêëàâäîïôöùûüç]{2,20}(?:[\s\-][A-Z][A-Za-zéèêëàâäîïôöùûüç]{2,20})?[\s\-](?i:Technolac)\b)|(?:\b(?i:Sophia)[\s\-](?i:Antipolis)\b)""",
    "street_fr": r"""(?i)\b\d{1,4}\s*,?\s*(?:bis|ter|quater)?\s*(?:rue|boulevard|bd|bld|blvd|avenue|av|impasse|allée|allee|chemin|route|place|quai|cours)\s+(?:de\s|du\s|des\s|d['’]|la\s|le\s|l['’])?[\w][\w \t\-'’./]{2,60}\b""",
    "street_fr_bare": r"""\b(?:Rue|Boulevard|BLD|BLVD|Avenue|Impasse|Allée|Allee|Chemin|Route|Place|Quai|Cours)\s+(?:(?:de|du|des|la|le|l['’]|d['’])\s+){0,2}[A-Z][\w \t\-'’./]{2,60}\b""",
    "street_fr_glued": r"""(?i)\b\d{0,4}\s*(?:rue|boulevard|bd|avenue|impasse|allee|chemin|route|place|quai|cours)(?:de|du|des|d[a-z]?|la|le|l[a-z]?)?[a-z]{2,40}""",
    "postal_city_it": r"""\b\d{5}[ \t]+[A-Z][A-Za-zàèéìòùÀÈÉÌÒÙ \t\-'.]{2,60}""",
    "street_it": r"""(?i)\b(?:Via|Viale|V\.le|Piazza|Pza|P\.za|Corso|C\.so|Vicolo|V\.lo|Largo|L\.go|Strada|Lungomare|Lungotevere|Riva|Salita|Calle)\s+(?:di\s|del\s|della\s|delle\s|degli\s|dei\s|d['’])?[\w][\w \t\-'’.]{2,60}""",
    "casella_postale_it": r"""(?i)\b(?:Casella\s+Postale|C\.?\s?P\.?)\s+\d{1,6}\b""",
    "zone_it": r"""(?:(?i:\b(?:Zona[ \t]Industriale|Zona[ \t]Artigianale|Centro[ \t]Direzionale|Centro[ \t]Commerciale|Parco[ \t]Industriale|Parco[ \t]Tecnologico|Distretto[ \t]Industriale|Polo[ \t]Industriale))[ \t]+(?:di[ \t]+|del[ \t]+|della[ \t]+|delle[ \t]+|d['’][ \t]*)?[A-ZÀ-Ý][\w \t\-'’/.]{2,60})""",
    "building_it": r"""(?:(?:[A-ZÀ-Ý][a-zàèéìòù]{3,20}[ \t]*-[ \t]*)?(?i:\b(?:Palazzo|Pal\.|Torre|Edificio|Edif\.|Blocco|Padiglione|Capannone))[ \t]+[A-ZÀ-Ý0-9][\w \t\-'’/.]{1,60})""",
    "postal_city_pt": r"""\b\d{4}[-\s]?\d{3}[ \t]+[A-ZÁÉÍÓÚÃÕÇ][A-Za-zàáâãéêíóôõúçÁÉÍÓÚÃÕÇ \t\-'.]{2,60}""",
    "street_pt": r"""(?i)\b(?:Rua|R\.|Avenida|Av\.|Av|Travessa|Largo|Praca|Praça|Estrada|Alameda|Beco|Calcada|Rotunda|Loteamento)\s+(?:de\s|do\s|da\s|dos\s|das\s|d['’])?[\w][\w \t\-'’.,]{2,80}""",
    "apartado_pt": r"""(?i)\bApartado\s+\d{1,6}\b""",
    "zone_pt": r"""(?:(?i:\b(?:Zona[ \t]Industrial|Parque[ \t]Industrial|Parque[ \t]Empresarial|Parque[ \t]Tecnol[óo]gico|Centro[ \t]Empresarial|Polo[ \t]Industrial))[ \t]+(?:de[ \t]+|do[ \t]+|da[ \t]+|dos[ \t]+|das[ \t]+|d['’][ \t]*)?[A-ZÁÉÍÓÚÃÕÇ][\w \t\-'’/.]{2,60})""",
    "building_pt": r"""(?:(?:[A-ZÁÉÍÓÚÃÕÇ][a-záéíóúãõç]{3,20}[ \t]*-[ \t]*)?(?i:\b(?:Edif[íi]cio|Edif\.|Torre|Bloco|Pavilh[ãa]o))[ \t]+[A-ZÁÉÍÓÚÃÕÇ0-9][\w \t\-'’/.]{1,60})""",
    "cep_br": r"""\b\d{5}-\d{3}[ \t]+[A-ZÁÉÍÓÚÃÕÇ][A-Za-zàáâãéêíóôõúçÁÉÍÓÚÃÕÇ \t\-'.]{2,60}""",
    "postal_eu_pt": r"""(?<![\w-])(?P<v>\d{4}-\d{3})(?![\w-])""",
    "postal_eu_uk": r"""(?<![A-Z0-9])(?P<v>[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2})(?![A-Z0-9])""",
    "postal_eu_pl": r"""(?<![\w-])(?P<v>\d{2}-\d{3})(?![\w-])""",
    "postal_eu_nl": r"""(?<![\dA-Z])(?P<v>\d{4}\s?[A-Z]{2})(?![A-Z0-9])""",
    "postal_eu_cz": r"""(?<![\d])(?P<v>\d{3}\s\d{2})(?![\d])""",
    "toponym_cardinal": r"""\b(?P<value>[A-ZÀ-Ý][a-zà-ÿ'’\-]{2,20}(?:\s+(?:de\s+|du\s+|des\s+|la\s+|le\s+|d['’]))?[A-ZÀ-Ý][a-zà-ÿ'’\-]{2,20}(?:\s+[A-ZÀ-Ý][a-zà-ÿ'’\-]{2,20})?\s+(?:Ouest|Est|Nord|Sud|OUEST|EST|NORD|SUD))\b""",
    "incoterm": r"""\b(?P<incoterm>EXW|FCA|CPT|CIP|DAP|DPU|DDP|FAS|FOB|CFR|CIF|DAT)[ \t]+(?P<location>[A-ZÀ-Ÿ][A-Za-zÀ-ÿ\-']{2,}(?:[ \t][A-ZÀ-Ÿa-z][A-Za-zÀ-ÿ\-']*){0,3})(?![A-Za-z])""",
    "plant": r"""(?<![A-Za-zÀ-ÿ])(?i:(?:Usine|Site|[ÉE]tablissement|Atelier|D[ée]p[ôo]t|Centre\s+(?:de\s+)?production|Plate(?:-?\s*)?forme\s+(?:logistique|industrielle)|Plant|Factory|Manufacturing\s+(?:facility|site|plant)|Production\s+(?:site|facility|plant)|Werk|Werkstandort|Standort|Fertigungsstätte|Fertigungsstaette|Planta|Fábrica|Fabrica|Centro\s+(?:de\s+)?producción|Centro\s+(?:de\s+)?produccion|Stabilimento|Fabbrica|Impianto|F[áa]brica|Unidade\s+(?:de\s+)?produ[çc][ãa]o|Zak[łl]ad(?:\s+produkcyjny)?|Fabryka|Z[áa]vod|Tov[áa]rna|Fabrika|Tesis|[ÜU]retim\s+tesisi)(?:[ \t]+(?:de[ \t]+|of[ \t]+|du[ \t]+|d['’]|von[ \t]+|di[ \t]+|do[ \t]+|en[ \t]+|in[ \t]+|à[ \t]+|w[ \t]+))?[ \t:\-]*)[A-ZÀ-Ý][A-Za-zÀ-ÿ0-9'’]{1,30}(?:[ \t\-/_][A-Za-zÀ-ÿ0-9'’]{1,30}){0,4}""",
    "header_source": r"""#\s*Fichier source:\s*([^\r\n]+)""",
    "name_comma": r"""[A-Z]{3,20},\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b""",
    "civilite": r"""(?<![A-Za-z])(?:M\.|Mme\.?|Mlle\.?|MR\.?|MME\.?|MLLE\.?|Mr\.?|Mrs\.?|Ms\.?|Monsieur|Madame|Mademoiselle)[ \t]+[A-Z][A-Za-z\-']+(?:[ \t]+[A-Z][A-Za-z\-']+){1,3}\b""",
    "prenom_nom": r"""\b[A-Z][a-zéèêëàâäîïôöùûüç]{2,15}[ \t]+[A-Z]{3,20}\b""",
    "prenom_nom_glued": r"""\b[A-Z][a-zéèêëàâäîïôöùûüç]{2,15}[ \t\-]*[A-Z][a-zéèêëàâäîïôöùûüç]{2,15}\b""",
    "bigram_fr": r"""\b[A-Z][a-zéèêëàâäîïôöùûüç]{2,15}\s+[A-Z][a-zéèêëàâäîïôöùûüç]{2,15}\b""",
    "title_de": r"""(?<![A-Za-z])(?:Sehr\s+geehrter?\s+)?(?:Herr|Frau|Dr\.?|Prof\.?|Dipl\.\-?Ing\.?|Dipl\.\-?Kfm\.?|Mag\.?|Ing\.?|Med\.?|Hr\.?|Fr\.?)(?:\s+(?:Dr\.?|Prof\.?|med\.?|jur\.?|rer\.?\s?nat\.?))*\s+[A-ZÄÖÜ][A-Za-zäöüÄÖÜß\-]{1,30}(?:\s+[A-ZÄÖÜ][A-Za-zäöüÄÖÜß\-]{1,30}){0,2}""",
    "title_en": r"""(?<![A-Za-z])(?:Mr\.?|Mrs\.?|Ms\.?|Miss|Mister|Madam|Madame|Sir|Lady|Dr\.?|Prof\.?|Rev\.?|Hon\.?)\s+[A-Z][A-Za-z\-']{1,30}(?:\s+[A-Z][A-Za-z\-']{1,30}){0,2}""",
    "title_es": r"""(?<![A-Za-z])(?:Sr\.?|Sra\.?|Srta\.?|Sres\.?|Don|Dn\.?|Dona|Dna\.?|D\.|Da\.|Dr\.?|Dra\.?|Lic\.?|Ing\.?|Prof\.?)\s+[A-ZÁÉÍÓÚÑ][A-Za-zàáéíóúñ\-']{1,30}(?:\s+[A-ZÁÉÍÓÚÑ][A-Za-zàáéíóúñ\-']{1,30}){0,3}""",
    "title_it": r"""(?<![A-Za-z])(?:Sig\.?|Sig\.?ra|Sig\.?na|Sigg\.?|Egr\.?|Dott\.?|Dr\.?|Dott\.?ssa|Dr\.?ssa|Prof\.?|Prof\.?ssa|Avv\.?|Ing\.?|Arch\.?|Geom\.?|Rag\.?)(?:\s+(?:Sig\.?|Dott\.?|Dr\.?))*\s+[A-Z][A-Za-zàèéìòù\-']{1,30}(?:\s+[A-Z][A-Za-zàèéìòù\-']{1,30}){0,2}""",
    "title_pt": r"""(?<![A-Za-z])(?:Sr\.?|Sra\.?|Srta\.?|Dr\.?|Dra\.?|Eng\.?|Engª|Prof\.?|Profª|Dom|Dona|D\.)\s+[A-ZÁÉÍÓÚÃÕÇ][A-Za-zàáâãéêíóôõúç\-']{1,30}(?:\s+[A-ZÁÉÍÓÚÃÕÇ][A-Za-zàáâãéêíóôõúç\-']{1,30}){0,3}""",
    "title_bg": r"""(?<![А-Яа-я])(?:г-н|г-жа|г-ца|господин|госпожа|госпожица)(?:\s+(?:г-н|г-жа|г-ца|господин|госпожа|госпожица))*\s+[А-Я][А-Яа-я\-']{1,30}(?:\s+[А-Я][А-Яа-я\-']{1,30}){0,1}""",
    "ngram_de": r"""\b[A-ZÄÖÜ][a-zäöüß]{2,15}(?:[\s\-][A-ZÄÖÜ][a-zäöüß]{2,15}){1,3}\b""",
    "bigram_en": r"""\b[A-Z][a-z]{2,15}\s+[A-Z][a-z]{2,15}\b""",
    "bigram_es": r"""\b[A-ZÁÉÍÓÚÑ][a-záéíóúñ]{2,15}\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]{2,15}\b""",
    "bigram_it": r"""\b[A-Z][a-zàèéìòù]{2,15}\s+[A-Z][a-zàèéìòù]{2,15}\b""",
    "bigram_pt": r"""\b[A-ZÁÉÍÓÚÃÕÇ][a-zàáâãéêíóôõúç]{2,15}\s+[A-ZÁÉÍÓÚÃÕÇ][a-zàáâãéêíóôõúç]{2,15}\b""",
    "bigram_bg": r"""\b[А-Я][а-я]{2,20}\s+[А-Я][а-я]{2,20}\b""",
    "group_names": r"""\b(?:MM\.?|Mmes?\.?|Messrs?\.?|Mss?\.?|Misses\.?)\s+(?P<list>[A-ZÀ-Ý][A-Za-zÀ-ÿ\-'’]{2,}(?:\s*(?:,\s*|\s+et\s+|\s+and\s+|\s+und\s+)[A-ZÀ-Ý][A-Za-zÀ-ÿ\-'’]{2,})+)""",
    "maiden_fr": r"""(?<!\w)(?:n[ée]e|nee)\s{1,3}(?P<name>[A-ZА-Я][A-Za-zÀ-ÿА-Яа-яЁё\-'’]{2,}(?:\s+[A-ZА-Я][A-Za-zÀ-ÿА-Яа-яЁё\-'’]{2,})?)""",
    "maiden_other": r"""(?i)(?<!\w)(?:born|geboren(?:e)?|nacida|nata|k[ıi]zl[ıi]k\s+soyad[ıi]|rozen[áaýyé]|[Мм]оминск[оа]\s+(?:име|фамилия)|[Мм]оминско\s+име)\s{1,3}(?P<name>[A-ZА-Я][A-Za-zÀ-ÿА-Яа-яЁё\-'’]{2,}(?:\s+[A-ZА-Я][A-Za-zÀ-ÿА-Яа-яЁё\-'’]{2,})?)""",
    "commercial_cell": r"""(?u)\b(?:Commercial(?:e)?(?:\s+\([eE]\))?|Vendeur|Acheteur|Acheteuse|Contact(?:\s+commercial)?|Suivi\s+par|Suivie?\s+par|G[ée]r[ée]\s+par|R[ée]ceptionnaire|Signataire|Demandeur|Responsable(?:\s+(?:commercial|qualit[ée]|secteur|client))?|Repr[ée]sentant|À\s+l['’]attention\s+de|A\s+l['’]attention\s+de|[ÀA]\s+l['’]\s*att\.?|Att(?:n)?\.?\s+de|Assistant(?:e)?(?:\s+commercial(?:e)?)?|Interlocuteur(?:\s+client)?|Affaire\s+suivie\s+par|Dossier\s+suivi\s+par|Sales\s+(?:rep|representative|contact)|Account\s+manager|Buyer|Purchaser|Contact\s+person|Attention(?:\s+of)?|Attn\.?|Ansprechpartner|Vertrieb(?:smitarbeiter)?|Ihre\s+Ansprechpartner|Vendedor|Comercial|Atenci[óo]n\s+de|Venditore|Commerciale)\s*[:.\-]?\s*(?P<value>[A-ZÀ-Ý][A-ZÀ-Ý\-'’]{1,30}(?:\s+[A-ZÀ-Ý][A-ZÀ-Ýa-zà-ÿ\-'’]{1,30}){0,2}|[A-ZÀ-Ý][a-zà-ÿ\-'’]{2,30}(?:\s+[A-ZÀ-Ý][A-Za-zÀ-ÿ\-'’]{1,30}){0,2})\b""",
    "birth_date": r"""(?i)(?P<label>n[ée]+s?\s+le|date\s+de\s+naissance|born(?:\s+on)?|date\s+of\s+birth|DOB|geboren\s+am|geburtsdatum|nacid[oa]s?\s+el|fecha\s+de\s+nacimiento|nat[oa]s?\s+il|data\s+di\s+nascita|nascid[oa]s?\s+(?:em|a)|data\s+de\s+nascimento|ur\.(?=\s+\d)|urodzon[ya]|data\s+urodzenia|do[ğg]um\s+tarihi|do[ğg]um(?=\s*[:：]?\s*\d)|do[ğg]du|do[ğg]mu[şs]|narozen[yýáaéeoóée]?|datum\s+narozen[íi]|nar\.(?=\s+\d)|出生日期|出生年月日|出生(?=\s*[:：]?\s*\d)|生年月日|[Дд]ата\s+на\s+раждане|[Рр]оден[ао]?(?=\s*(?:на|в|\d|:)))[^\d\n]{0,50}(?:(?P<dmy>\d{1,2}[/.\-]\s?\d{1,2}[/.\-]\s?\d{2,4})|(?P<ymd>\d{4}[/.\-]\s?\d{1,2}[/.\-]\s?\d{1,2})|(?P<cjk>\d{4}年\d{1,2}月\d{1,2}日))""",
    "birth_date_before": r"""(?i)(?P<dmy>\d{1,2}[/.\-]\s?\d{1,2}[/.\-]\s?\d{2,4}|\d{4}年\d{1,2}月\d{1,2}日)[^\d\n]{0,50}?(?:do[ğg]umlu|生[于於])""",
    "company_header": r"""(?:^|\n)\s*[|=\-]*\s*(?P<acr>[A-Z](?:\.[A-Z]){1,5}\.?|[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\-]{2,}[+®™])(?=\s*(?:[|\-=]|\n|$))""",
    "org_structure": r"""(?im)^\s*(?P<value>Comptabilit[ée]\s+[Ff]ournisseurs?|Comptabilit[ée]\s+(?:clients|generale|analytique)|Service\s+(?:comptabilit[ée]|client|achats|qualit[ée]|production|logistique|approvisionnement)|D[ée]partement\s+(?:Achats|Ventes|Production|Qualit[ée]|Logistique|RH)|Direction\s+(?:Achats|Industrielle|Financi[èe]re|Technique|Generale)|Accounts?\s+Payable|Purchasing\s+Department|Quality\s+(?:department|control|assurance)|Kreditorenbuchhaltung|Eink(?:auf|aufsabteilung)|Contabilidad\s+(?:proveedores|clientes)|Departamento\s+(?:compras|ventas|calidad)|Cuentas\s+a\s+pagar|Contabilit[àa]\s+fornitori|Ufficio\s+(?:acquisti|qualit[àa])|Reparto\s+acquisti)\b""",
    "paren": r"""\(([^)\n]{4,120})\)""",
    "order_ref": r"""(?ui)(?:Votre\s+(?:commande|r[ée]f[ée]rence|n[°o]\s*de\s+commande|cde)|N[°o]\s*(?:de\s+)?commande\s+client|R[ée]f[ée]rences?\s+(?:commande|client|cde|du\s+client)|R[ée]f\.?\s*(?:client|commande|cde)|N[°o]\s*cde\s+client|N[°o]\s*ordre(?:\s+client)?|Vos\s+r[ée]f[ée]rences?|Vos\s+r[ée]f\.?|Vos\s+(?:n[°o]\s+de\s+)?cde|Bon\s+de\s+commande\s+(?:client|n[°o])|BCD\s+N[°o]|N[°o]\s*BCD|Cde\s+client|Commande\s+(?:client|n[°o])|Your\s+(?:order|purchase\s+order|PO|reference)|Customer\s+(?:order|reference|PO)|Client\s+reference|Purchase\s+order\s+(?:no\.?|number|#)?|Order\s+(?:reference|number|no\.?)|Ihre\s+(?:Bestellung|Bestellnummer|Bestell-Nr\.?|Bestell\s+Nr\.?|Referenz)|Bestellnummer\s+Kunde|Kunden(?:bestellung|nummer|referenz)|Su\s+(?:pedido|orden|referencia)|N[°o]\s*(?:de\s+)?pedido\s+(?:cliente|del\s+cliente)|Referencia\s+(?:del\s+)?cliente|Pedido\s+cliente|Vostro\s+(?:ordine|numero\s+ordine|riferimento)|Vs\.?\s*ordine|Riferimento\s+cliente|Vossa\s+(?:encomenda|referência|referencia|ordem)|Refer[êe]ncia\s+(?:do\s+)?cliente|N[°ºo]\s*(?:de\s+)?encomenda|Wasze\s+(?:zam[óo]wienie|zamowienie|odniesienie)|Numer\s+zam[óo]wienia\s+klienta|Referencja\s+klienta|Sipari[şs]\s+(?:no|numaras[ıi])|M[üu][şs]teri\s+sipari[şs]|Referans\s+no|Va[šs]e\s+(?:objedn[áa]vka|reference|číslo\s+objedn[áa]vky)|[ČC][íi]slo\s+objedn[áa]vky|您的(?:订单|採購單|採购单|订货号)|客户(?:订单|订货号)号?|採購單號|采购订单|お客様の?注文(?:番号)?|貴注文番号|注文書番号|Ваша(?:та)?\s+поръчка|Номер\s+на\s+поръчка|Клиентска\s+поръчка)[ \t:#/.\-]{0,5}(?P<value>[A-Z0-9](?:[A-Z0-9\-/]){4,14})\b""",
    "order_signature": r"""(?<!\d)(?P<value>4[27]00\d{6})(?!\d)""",
    "order_label": r"""(?uim)(?:(?:Votre\s+(?:commande|r[ée]f[ée]rence|n[°o]\s*de\s+commande|cde)|N[°o]\s*(?:de\s+)?commande\s+client|R[ée]f[ée]rences?\s+(?:commande|client|cde|du\s+client)|R[ée]f\.?\s*(?:client|commande|cde)|N[°o]\s*cde\s+client|N[°o]\s*ordre(?:\s+client)?|Vos\s+r[ée]f[ée]rences?|Vos\s+r[ée]f\.?|Vos\s+(?:n[°o]\s+de\s+)?cde|Bon\s+de\s+commande\s+(?:client|n[°o])|BCD\s+N[°o]|N[°o]\s*BCD|Cde\s+client|Commande\s+(?:client|n[°o])|Your\s+(?:order|purchase\s+order|PO|reference)|Customer\s+(?:order|reference|PO)|Client\s+reference|Purchase\s+order\s+(?:no\.?|number|#)?|Order\s+(?:reference|number|no\.?)|Ihre\s+(?:Bestellung|Bestellnummer|Bestell-Nr\.?|Bestell\s+Nr\.?|Referenz)|Bestellnummer\s+Kunde|Kunden(?:bestellung|nummer|referenz)|Su\s+(?:pedido|orden|referencia)|N[°o]\s*(?:de\s+)?pedido\s+(?:cliente|del\s+cliente)|Referencia\s+(?:del\s+)?cliente|Pedido\s+cliente|Vostro\s+(?:ordine|numero\s+ordine|riferimento)|Vs\.?\s*ordine|Riferimento\s+cliente|Vossa\s+(?:encomenda|referência|referencia|ordem)|Refer[êe]ncia\s+(?:do\s+)?cliente|N[°ºo]\s*(?:de\s+)?encomenda|Wasze\s+(?:zam[óo]wienie|zamowienie|odniesienie)|Numer\s+zam[óo]wienia\s+klienta|Referencja\s+klienta|Sipari[şs]\s+(?:no|numaras[ıi])|M[üu][şs]teri\s+sipari[şs]|Referans\s+no|Va[šs]e\s+(?:objedn[áa]vka|reference|číslo\s+objedn[áa]vky)|[ČC][íi]slo\s+objedn[áa]vky|您的(?:订单|採購單|採购单|订货号)|客户(?:订单|订货号)号?|採購單號|采购订单|お客様の?注文(?:番号)?|貴注文番号|注文書番号|Ваша(?:та)?\s+поръчка|Номер\s+на\s+поръчка|Клиентска\s+поръчка)|N[°o]\s*(?:de\s+)?[Cc]ommande|N[°o]\s*[Cc]de|N[°o]\s*comm\.?|N[°o]?comm\.|[Cc]ommande\s+(?:n[°o]|client|du|de)|^\s*[Cc]ommande\s*$|\b[Cc]ommande\b(?=\s*[A-Z0-9])|Votre\s+ref\.?\s+du|Votre\s+n[°o]\s+de\s+cde|V\s*/\s*Cde|VCde|V\.?Cde|R[ée]f\.?\s+(?:du\s+)?(?:client|commande)|R[ée]f[ée]rence\s*:?\s*$|N[°o]\s+de\s+[Cc]ommande|no\.?\s+de\s+l['’]?\s*ordre|CDE\s+\d|Order\s*(?:no\.?|n[°o]\.?|number|#)|^Order\s*$)""",
    "client_code": r"""(?i)(?:N[°o]\.?\s*(?:de\s+)?client(?:\s+(?:factur[ée]|livr[ée]|command[ée]))?|N[°o]\.?\s+client(?:\s+(?:factur[ée]|livr[ée]|command[ée]))?|No\.\s*client|Client\s+n[°o]\.?|Client\s+no\.?\b|Code\s+client(?:\s+(?:factur[ée]|livr[ée]|command[ée]))?|N[°o]\s*(?:de\s+)?compte\s+client|Compte\s+client|Compte\s+adresse|Compte\s+de\s+(?:facturation|livraison)|Compte\s+fournisseur|(?:Votre\s+)?Num[ée]ro\s+de\s+compte(?:\s+[A-Z]{2,5})?|(?:Votre\s+)?N[°o]\s+de\s+compte(?:\s+[A-Z]{2,5})?|(?:Votre\s+)?compte\s+[A-Z]{2,5}\b|Num[ée]ro\s+(?:de\s+)?client|N[°o]\s+fournisseur|Code\s+fournisseur|No\.?\s*fournisseur|Num\.?\s+fournisseur|Dossier(?:\s+n[°o]\.?)?(?!\s+suivi)|Compte|N[°o]\s*RS|R[ée]f\.?\s*RS|Donneur\s+d['’]ordre|Adresse\s+(?:de\s+)?livraison|Livraison\s+[àaAÀ]|Facturation\s+[àaAÀ]|Livr[ée]\s+[àaAÀ]|Facturer?\s+[àaAÀ]|Factur[ée]\s+[àaAÀ]|Adress[ée]\s+[àaAÀ]|Client\s+(?:livr[ée]|factur[ée]|command[ée])|Destinataire\s+(?:facture|facturation|livraison)|Receptionnaire\s+facture|Sold\s+to|Bill\s+to|Ship\s+to|Delivery\s+(?:to|address)|Billing\s+(?:to|address)|Invoice\s+(?:to|address)|Customer\s+(?:no|number|code|account|id|reference|ref\.?)|Customer\s+account\s+(?:no|number|code)|Account\s+(?:no|number|code|holder|reference)|Client\s+(?:no|number|code|id|reference)|Acct\.?\s*no|Your\s+(?:customer\s+)?(?:no|number|code|account|reference)|Recipient\s+(?:no|number|code)|Buyer\s+(?:no|number|code)|Kundennummer|Kunden-Nr\.?|Kunden\s+Nr\.?|Konto-?Nr\.?|Kontonummer|Kundenkonto|Rechnungsempf[äa]nger|Rechnungsadresse|Lieferadresse|Lieferanschrift|Liefer[uü]ng\s+an|Versand\s+an|Ihre\s+Kunden(?:nummer|-Nr\.?)|N[°ºo]\.?\s*(?:de\s+)?cliente|N[°ºo]\.?cliente|C[óo]digo\s+(?:de\s+)?cliente|Direcci[óo]n\s+(?:de\s+)?(?:entrega|env[íi]o|facturaci[óo]n)|Entrega\s+a|Facturaci[óo]n\s+a|Facturar\s+a|Cuenta\s+(?:de\s+)?cliente|N[°o]\.?\s*(?:di\s+)?cliente|Codice\s+(?:di\s+)?cliente|Indirizzo\s+(?:di\s+)?(?:consegna|spedizione|fatturazione)|Consegna\s+a|Fatturazione\s+a|Fatturare\s+a|Conto\s+cliente|N[°ºo]\.?\s*(?:de\s+)?cliente|C[óo]digo\s+(?:do\s+)?cliente|Endere[çc]o\s+(?:de\s+)?(?:entrega|envio|factura[çc][ãa]o|faturamento)|Entrega\s+a|Faturar\s+a|Conta\s+(?:do\s+)?cliente|Klantnummer|Klant-?Nr\.?|Klantcode|Leveringsadres|Verzendadres|Factuuradres|Afleveren\s+aan)[\s:#.\-/]*(?:(?!\s*(?:Accus[ée]\s+de\s+r[ée]ception|Confirmation\s+de\s+commande|Confirmation\s+Commande|Auftragsbest[äa]tigung|Bestellbest[äa]tigung|Order\s+confirmation|Acknowledgment\s+of\s+order|Sales\s+confirmation|Num[ée]ro\s+du\s+document|Notre\s+AR|Doc\.?\s*Vente|Conferma\s+d['']?ordine|Confirmaci[óo]n\s+de\s+pedido|Confirma[çc][ãa]o\s+de\s+encomenda))[A-Za-zéèà][^\n0-9]{0,50}[:\n])?[\s:#.\-/]*(?P<value>(?=[A-Z0-9\-/]*\d[A-Z0-9\-/]*\d[A-Z0-9\-/]*\d)[A-Z0-9][A-Z0-9\-/]{2,14})\b""",
    "affair": r"""(?i)(?:N[°o]\s*(?:d['’]\s*)?affaire|N[°o]\s+affaire|R[ée]f\.?\s+(?:de\s+l['’]?)?affaire|R[ée]f[ée]rence\s+(?:de\s+l['’]?)?affaire|Affaire\s+N[°o]\.?|Affaire\s+(?:n[°o]|reference)|N[°o]\s*dossier|N[°o]\s+de\s+dossier|R[ée]f\.?\s+dossier|R[ée]f[ée]rence\s+dossier|Dossier\s+N[°o]\.?|Dossier\s+n[°o]|Project\s+(?:n[°o]\.?|number|ref)|Case\s+(?:n[°o]\.?|number)|File\s+(?:n[°o]\.?|number|ref)|Projektnummer|Aktenzeichen|N[°ºo]\s+expediente|N[°o]\s+pratica)\s*[:.#\-]?\s*(?:\[[A-Z_]+(?:_\d+)?\]|[^\n])*?(?P<value>[A-Z0-9](?:[A-Z0-9\-/_.]){2,24})\b""",
    "internal_ref": r"""(?i)(?<![A-Za-z])(?:BL(?:\s*N[°o]\.?)?|Bon\s+de\s+livraison(?:\s*N[°o]\.?)?|RMA(?:\s*N[°o]\.?)?|AR(?:\s*N[°o]\.?)?|Accus[ée]\s+(?:de\s+)?r[ée]ception(?:\s*N[°o]\.?)?|SC(?:\s*N[°o]\.?)?|CC(?:\s*N[°o]\.?)?|Confirmation\s+(?:de\s+)?commande(?:\s*N[°o]\.?)?|Notre\s+(?:r[ée]f[ée]rence|n[°o]|cde)|Nos?\s+r[ée]f\.?|N[°o]\s*(?:d['’])?affaire|R[ée]f[ée]rence\s+(?:affaire|dossier)|Affaire\s+N[°o]\.?|Dossier\s+(?:n[°o]\.?|de\s+r[ée]f)|Order\s+ack(?:nowledgement)?|Delivery\s+note|Confirmation\s+(?:number|n[°o]\.?)|Auftragsbest[äa]tigung(?:\s*Nr\.?)?|Lieferschein(?:\s*Nr\.?)?|Albar[áa]n(?:\s+n[°ºo]\.?)?|Confirmaci[óo]n\s+pedido)\s*[:.\-/#]?\s*(?P<value>[A-Z0-9][A-Z0-9\-/]{3,24})(?![A-Za-z0-9])""",
    "confirmation_header": r"""(?i)(?:Accus[ée]\s+(?:de\s+)?r[ée]ception|Confirmation\s+(?:de\s+)?commande|Auftragsbest[äa]tigung|Order\s+confirmation|Acknowledgment\s+of\s+order|Sales\s+confirmation|Confirmaci[óo]n\s+(?:de\s+)?pedido|Conferma\s+d['']?ordine|Confirma[çc][ãa]o\s+(?:de\s+)?encomenda|Potwierdzenie\s+zam[oó]wienia|Siparis\s+onayi|注文\s*確認|チュウモン\s*カクニン)""",
    "tracking_dhl": r"""(?i)\bDHL\b[\s.:#\-]{0,15}(?P<v>\d{10})\b""",
    "tracking_ups": r"""\b(?P<v>1Z[A-Z0-9]{16})\b""",
    "tracking_chronopost": r"""\b(?P<v>[A-Z]{2}\d{9}[A-Z]{2})\b""",
    "tracking_fedex": r"""(?i)\bFedEx\b[\s.:#\-]{0,15}(?P<v>\d{12,15})\b""",
    "tracking_gls": r"""(?i)\bGLS\b[\s.:#\-]{0,15}(?P<v>\d{11}(?:\d{3})?)\b""",
    "tracking_dpd": r"""(?i)\bDPD\b[\s.:#\-]{0,15}(?P<v>\d{14})\b""",
    "tracking_tnt": r"""(?i)\bTNT\b[\s.:#\-]{0,15}(?P<v>\d{9,12})\b""",
    "tracking_schenker": r"""(?i)\bSchenker\b[\s.:#\-]{0,15}(?P<v>\d{8,12})\b""",
    "tracking_labelled": r"""(?ui)(?:N[°o]\s*(?:de\s+)?suivi|N[°o]\s*suivi|Num[ée]ro\s+(?:de\s+)?suivi|R[ée]f[ée]rence\s+(?:de\s+)?(?:suivi|colis|exp[ée]dition)|Suivi\s+(?:colis|exp[ée]dition)?|Tracking|N[°o]\s*(?:de\s+)?colis|N[°o]\s*BL|N[°o]\s*exp[ée]dition|Tracking\s*(?:number|n[°o]\.?|ID|code|reference)|Track(?:ing)?\s*N[°o]\.?|Waybill\s*(?:number|n[°o]\.?)?|Shipment\s*(?:number|ID|reference)|AWB\s*(?:number|n[°o]\.?)?|Sendungsnummer|Sendungs-Nr\.?|Track-Nummer|Versandnummer|Frachtbrief(?:nummer)?|N[°ºo]\s*(?:de\s+)?seguimiento|N[úu]mero\s+de\s+seguimiento|N[°o]\.?\s*(?:di\s+)?spedizione|N[°o]\.?\s*tracking|Codice\s+spedizione|N[°ºo]\.?\s*(?:de\s+)?rastreamento|N[°ºo]\.?\s*expedi[çc][ãa]o|快递单?号|追踪号|物流单号|運單號|物流追蹤|追跡番号|配送番号|送り状番号|Numer\s+(?:przesy[łl]ki|[śs]ledzenia)|[ČC][íi]slo\s+z[áa]silky|Takip\s+(?:no|numaras[ıi])|Kargo\s+(?:takip\s+)?no|Номер\s+за\s+проследяване|Товарителница)\s*[:#.\-]?\s*(?P<v>[A-Z0-9]{6,30}(?:[\s\-/][A-Z0-9]{2,8}){0,3})""",
    "compact_date": r"""(?<!\d)(?P<value>(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d{2}|(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]))(?!\d)""",
    "socsec_fr": r"""(?<!\d)(?P<value>[12](?:\s|\.)?\d{2}(?:\s|\.)?\d{2}(?:\s|\.)?\d{2}(?:\s|\.)?\d{3}(?:\s|\.)?\d{3}(?:\s|\.|/|\s/)?\s?\d{2})(?!\d)""",
    "socsec_fr_context": r"""(?i)(?:securite\s+sociale|s[ée]curit[ée]\s+sociale|s[ée]cu|NIR|NNI|num[ée]ro\s+(?:de\s+)?s[ée]cu|assur[ée]\s+social|seguridad\s+social|n[úu]mero\s+(?:de\s+)?seguridad|seguran[çc]a\s+social|sicurezza\s+sociale)""",
    "urssaf": r"""(?i)n[°o]?\s*URSSAF\s*[:\-]?\s*(?P<value>\d{3}[\s\-]?\d{4}[\s\-]?\d{2})""",
    "uk_ni": r"""(?<![A-Z])(?P<value>[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z])(?![A-Z])""",
    "uk_ni_context": r"""(?i)(?:national\s+insurance|NINO|NI\s+number|NI\s+no)""",
    "uk_driver": r"""(?i)driv(?:ing|er.?s)\s+licen[sc]e\s*(?:n[°o]?\.?)?\s*(?P<value>[A-Z0-9]{10,18})""",
    "uk_utr": r"""(?i)(?:UTR|Unique\s+Taxpayer\s+Reference)\s*[:\-]?\s*(?P<value>\d{3}[\s\-]?\d{3}[\s\-]?\d{3,4})""",
    "hmrc": r"""(?i)\bHMRC[\s\-]\d{3}[\s\-]?\d{4}[\s\-]?\d{2}\b""",
    "es_dni": r"""(?<![A-Z0-9])(?P<value>\d{8}[A-HJ-NP-TV-Z])(?![A-Z0-9])""",
    "es_id_context": r"""(?i)\b(?:DNI|NIE|NIF|CIF|C\.I\.F)\b""",
    "es_nie": r"""(?<![A-Z0-9])(?P<value>[XYZ]\d{7}[A-HJ-NP-TV-Z])(?![A-Z0-9])""",
    "es_cif": r"""(?<![A-Z0-9])(?P<value>[ABCDEFGHJNPQRSUVW][\s\-]?\d{8})(?![A-Z0-9])""",
    "es_ccc": r"""(?i)(?:cuenta\s+(?:de\s+)?cotizaci[oó]n|CCC|Reg\.?\s*Esp\.?\s*Aut[oó]nomos)[\s\-:.\w]{0,30}?(?P<value>\d{2}[\s\-/]?\d{6,8}[\s\-/]?\d{1,2})""",
    "de_hr": r"""(?i)\bHR[AB]\b[\s:nr.\-]{0,15}(?P<value>\d{3,8})""",
    "de_id": r"""(?i)\b(?:Sozialversicherungs(?:nummer|nr\.?)|SVN[Rr]|SV[\.\-]?N[rR]\.?|Renten(?:versicherungs)?nummer|RVN[rR]|Steuer[\s\-]?Identifikations(?:nummer|nr\.?)|Steuer[\s\-]?ID|Mitglieds(?:nummer|nr\.?)|Krankenversicherungs(?:nummer|nr\.?))[\s:\-\(\)\w]{0,30}?(?P<value>(?-i:[A-Z0-9])(?:[\s\-/]?(?-i:[A-Z0-9])){7,24})""",
    "cn_passport": r"""(?:护照(?:编号|号码)?|護照(?:編號|號碼)?|passport\s+(?:number|n[°o])?)[^\dA-Z\n]{0,15}?(?P<value>[A-Z]{1,2}\d{7,8})""",
    "cn_id": r"""(?:身份证(?:号码?)?|身份证号|身分證(?:號碼?)?|身份證(?:號)?|居民身份证|shenfenzheng|ID\s*card|ID\s*No\.?|ID)[^\d]{0,30}?(?P<value>\d{17}[\dXx])""",
    "cn_uscc": r"""(?:统一社会信用代码|统一信用代码|社会信用代码|Unified\s+Social\s+Credit\s+Code|USCC)\s*[:：\-]?\s*(?P<value>[0-9A-HJ-NP-RT-Y]{18})""",
    "cn_hkid": r"""(?i)\bHKID\s*[:\-]?\s*(?P<value>[A-Z]{1,2}\d{6}\(?\d|[A-Z]\)?)""",
    "bank_account": r"""(?i)(?:口座番号|銀行口座|振込先口座|账[号户]|银行账[号户]|开户行账[号户]|Account\s*(?:No\.?|Number)?|A/?C\s*No\.?|N[°o]\s*(?:de\s+)?compte)[\s:：\-]{0,5}(?P<value>[A-Z0-9][A-Z0-9\s\-]{6,30}\d)""",
    "jp_number": r"""(?:マイナンバー|個人番号|My\s*Number)[^\d]{0,30}?(?P<value>\d{4}[\s\-]?\d{4}[\s\-]?\d{4})""",
    "jp_corporate": r"""(?:法人番号|Corporate\s+Number|Hojin\s+Bango)\s*[:：\-]?\s*(?P<value>\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d|\d{13})""",
    "jp_licence": r"""(?:運転免許証(?:番号)?|運転免許番号|driver.s?\s+licen[sc]e)\s*[:：\-]?\s*(?P<value>\d{12})""",
    "jp_passport": r"""(?:パスポート(?:番号)?|旅券番号|passport\s+(?:number|n[°o])?)\s*[:：\-]?\s*(?P<value>[A-Z]{2}\d{7})""",
    "jp_health": r"""(?:健康保険証番号|保険証番号|健康保険番号)[^\d\n]{0,30}?(?P<value>\d{4,12}[\s\-]?\d{1,8})""",
    "jp_registry": r"""(?:法人登記番号|商業登記番号|会社法人等番号|登記番号)[^\d\n]{0,20}?(?P<value>\d{4}\-\d{2}\-\d{6}|\d{6}\-\d{6,7}|\d{12,13})""",
    "kr_business": r"""(?:사업자등록번호|법인등록번호)[^\d\n]{0,20}?(?P<value>\d{3}\-\d{2}\-\d{5}|\d{6}\-\d{7})""",
    "kr_rrn": r"""(?:주민등록번호|RRN)[^\d\n]{0,20}?(?P<value>\d{6}\-[1-8]\d{6})""",
    "it_cf": r"""\b(?P<value>[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z])\b""",
    "it_sdi": r"""(?i)(?:Codice\s+(?:SDI|SdI|destinatario|univoco)|SDI|SdI)\s*[:\-]?\s*(?P<value>[A-Z0-9]{7})\b""",
    "it_regulatory": r"""(?i)(?:Albo(?:\s+Nazionale)?(?:\s+Gestori\s+Ambientali)?|INPS(?:\s+(?:Artigiani|Gestione|Commercianti))?|INAIL|Iscrizione(?:\s+(?:al\s+)?(?:Albo|INPS|INAIL|Registro))?|matricola|EORI(?:\s+IT)?)[^\d]{0,30}?(?P<value>IT\d{11}|[A-Z]{2}\-?\d{2,3}\-\d{6,12}|\d{2,3}\.\d{3}\.\d{3}\-?[A-Z]{0,2}|\d{10,13})""",
    "it_tessera": r"""(?i)Tessera\s+Sanitaria[^\d\n]{0,20}?(?P<value>\d{10,20}(?:[/\-]\d{1,3})?)""",
    "bg_egn": r"""(?:ЕГН|EGN|Единен\s+граждански\s+номер)[^\d]{0,20}?(?P<value>\d{10})""",
    "bg_eik": r"""(?:ЕИК|EIK|БУЛСТАТ|BULSTAT|Единен\s+идентификационен\s+код)[^\d]{0,20}?(?P<value>\d{9}(?:\d{4})?)""",
    "bg_lnch": r"""(?:ЛНЧ|LNCH|Личен\s+номер\s+на\s+чужденец)[^\d]{0,20}?(?P<value>\d{10})""",
    "bg_id_card": r"""(?:Лична\s+карта|карта\s+за\s+самоличност|Паспорт|Passport)[^\d\n]{0,30}?(?:№|N|No|номер|серия)?\s*[:\-]?\s*(?P<value>[A-Z]?\d{9}|\d{9})""",
    "bg_health": r"""(?:НЗОК|NZOK|Здравна\s+книжка|Здравноосигурителен\s+номер)[^\d]{0,30}?(?P<value>\d{8,12})""",
    "cz_cssz": r"""(?i)\b(?:[ČC]SSZ(?:\s+ev\.?\s*[čc]\.?)?|Eviden[čc]n[íi]\s+[čc]\.?\s*[ČC]SSZ)[\s:\-\.]{0,15}?(?P<value>\d{4}[\-\s]\d{4,8}[\-\s]\d{2,4}|\d{6}[\s/\-]\d{3,4}|\d{2}[\s\-]?\d{6,12}|\d{8,14})""",
    "cz_rc": r"""(?i)\b(?:Rodn[éeě]\s+[čc]íslo|R[ČC])(?:[^0-9\n]{0,30})(?P<value>\d{6}[\s/\-]?\d{3,4})""",
    "cz_ico": r"""(?i)\b(?:I[ČC]O|Identifika[čc]n[íi]\s+[čc]íslo(?:\s+osoby)?)\s*[:\-]?\s*(?P<value>\d{8})""",
    "cz_dic": r"""(?i)\b(?:DI[ČC]|Da[ňn]ov[éeě]\s+identifika[čc]n[íi]\s+[čc]íslo)\s*[:\-]?\s*(?P<value>(?:CZ|SK)\s?\d{8,10})""",
    "cz_op": r"""(?i)\b(?:Ob[čc]ansk[éý]\s+pr[ůu]kaz|[ČC][íi]slo\s+OP|OP\s+[čc][íi]slo)[\s:\-čc.íi]{0,15}?(?P<value>\d{3}[\s\-]?\d{3}[\s\-]?\d{3}|[A-Z0-9]{6,12})""",
    "tr_tckn": r"""(?i)\b(?:T\.?C\.?\s*Kimlik\s*N(?:o|umaras[ıi])?|TCKN|Kimlik\s+N(?:o|umaras[ıi]))\s*[:\-]?\s*(?P<value>\d{11})""",
    "tr_vkn": r"""(?i)\b(?:VKN|Vergi\s+(?:Kimlik\s+)?N(?:o|umaras[ıi]))\s*[:\-]?\s*(?P<value>\d{10})""",
    "tr_sgk": r"""(?i)\b(?:SGK(?:\s+(?:i[şs]veren\s+)?N(?:o|umaras[ıi]))?|Sosyal\s+G[üu]venlik(?:\s+(?:i[şs]veren\s+)?N(?:o|umaras[ıi]))?)\s*[\-:]?\s*(?P<value>\d{1,2}\s\d{2}\s\d{2}\s\d{2}\s\d{3}\s\d{3}\s*/?\s*\d{2}|\d{4}[\-\s]\d{4,8}[\-\s]\d{2,4}|\d{2}[\-\s]\d{4,6}[\-\s]\d{2,4}|\d{10,14})""",
    "tr_sicil": r"""(?i)\b(?:Ticaret\s+Sicil\s+N(?:o|umaras[ıi])?|Sicil\s+N(?:o|umaras[ıi])|MERS[İI]S(?:\s+N(?:o|umaras[ıi]))?)\s*[:\-]?\s*(?P<value>\d{4,18})""",
    "pl_nip": r"""(?i)\bNIP\b(?:[^0-9\n]{0,30})(?P<value>(?:PL\s?)?\d{3}[\s\-]?\d{2,3}[\s\-]?\d{2,3}[\s\-]?\d{2,3})""",
    "pl_regon": r"""(?i)\bREGON\s*[:\-]?\s*(?P<value>\d{9}(?:\d{5})?)""",
    "pl_krs": r"""(?i)\bKRS\s*[:\-]?\s*(?P<value>\d{10})""",
    "pl_pesel": r"""(?i)\bPESEL\s*[:\-]?\s*(?P<value>\d{11})""",
    "pt_nif": r"""(?<![A-Z0-9])(?P<value>\d{3}[\s\-]?\d{3}[\s\-]?\d{3})(?![A-Z0-9])""",
    "pt_nif_context": r"""(?i)\b(?:NIPC|NIF|n[úu]mero\s+(?:de\s+)?contribuinte|contribuinte|IVA\s+intracom\.?\s*PT|IVA\s+PT)\b""",
    "pt_cc": r"""(?i)(?:cart[ãa]o\s+(?:de\s+)?cidad[ãa]o(?:\s*\(CC\))?|\bCC\b)[\s\-:nº.º]{0,15}?(?P<value>\d{3}\s?\d{3}\s?\d{3}\s?[A-Z]{2}\s?\d?)""",
    "pt_niss": r"""(?i)(?:NISS|n[úu]mero\s+(?:da\s+)?seguran[çc]a\s+social|seguran[çc]a\s+social\s*n[úu]mero|seguran[çc]a\s+social)[\s\-:n°.º]{0,15}?(?P<value>\d{2,3}(?:[\s\-]?\d){9,15})""",
    "national_id": r"""(?i)(?P<label>CNI\s*n[°o]?|carte\s+(?:nationale\s+)?d['’]identit[ée]\s*(?:n[°o]?)?|num[ée]ro\s+de\s+CNI|n[°o]\s+de\s+CNI|pi[èe]ce\s+d['’]identit[ée]\s+communiqu[ée]e\s*(?::|\-)?\s*CNI|registre\s+national|num[ée]ro\s+national|DNI\s*n[°o]?|NIF\s*n[°o]?|Personalausweis(?:[\s\-]*Nr\.?)?|Ausweisnummer|N[üu]fus\s+c[üu]zdan[ıi](?:\s+seri/?no)?(?:\s*no)?|national\s+ID(?:\s*number)?|ID\s+card\s+number|passport\s+(?:number|n[°o]))[^\d\nA-Z]{0,30}(?P<id>[A-Z0-9][A-Z0-9.\- ]{6,22}[A-Z0-9])""",
}
