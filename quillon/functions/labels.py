"""Labels of table columns and words that no person is called: fixed values, in published order."""

#: Column labels whose values are kept, by what they are. Where two kinds have a label, the later one holds.
TABLE_LABELS = {
    "PERSON": (
        "commercial", "commerciale", "vendeur", "acheteur", "contact", "suivi par", "responsable", "representant", "représentant", "demandeur",
        "signataire", "assistant(e)", "assistant", "assistante", "interlocuteur", "à l'attention de", "a l'attention de", "sales rep",
        "sales representative", "salesperson", "buyer", "purchaser", "account manager", "attention", "attn", "attn.", "for the attention of",
        "to the attention of", "ansprechpartner", "kontakt", "verkäufer", "verkaeufer", "einkäufer", "einkaeufer", "vertreter", "zu händen", "z.hd.",
        "z. hd.", "contacto", "vendedor", "comprador", "representante", "a la atencion de", "a la atención de", "contatto", "venditore",
        "acquirente", "rappresentante", "all'attenzione di", "à atenção de", "a atencao de", "contactpersoon", "verkoper", "ter attentie van",
        "t.a.v.",
    ),
    "CLIENT_CODE": (
        "client", "n° client", "no client", "no. client", "no.client", "n°client", "code client", "numero client", "numéro client",
        "numero de client", "numéro de client", "n° de client", "no de client", "client n°", "client no", "client no.", "compte client",
        "compte adresse", "sold to", "code fournisseur", "n° fournisseur", "no fournisseur", "no.fournisseur", "customer no", "customer no.",
        "customer number", "customer code", "customer id", "customer account", "customer reference", "client number", "client code", "account no",
        "account number", "bill to", "ship to", "delivery to", "delivery address", "billing address", "buyer", "recipient", "your customer no",
        "your customer number", "your reference", "kundennummer", "kunden-nr", "kunden-nr.", "kunden nr", "kontonummer", "konto-nr", "kundenkonto",
        "rechnungsempfänger", "rechnungsempfaenger", "rechnungsadresse", "lieferadresse", "lieferanschrift", "lieferung an", "versand an",
        "ihre kundennummer", "ihre kunden-nr", "n° cliente", "no cliente", "numero cliente", "número cliente", "n° de cliente", "numero de cliente",
        "número de cliente", "codigo cliente", "código cliente", "codigo de cliente", "código de cliente", "cuenta cliente", "direccion de entrega",
        "dirección de entrega", "direccion de facturacion", "dirección de facturación", "entrega a", "facturar a", "facturacion a", "facturación a",
        "codice cliente", "codice di cliente", "n° di cliente", "numero di cliente", "conto cliente", "indirizzo di consegna",
        "indirizzo di spedizione", "indirizzo di fatturazione", "consegna a", "fatturare a", "fatturazione a", "no de cliente", "n° do cliente",
        "codigo do cliente", "código do cliente", "conta do cliente", "endereco de entrega", "endereço de entrega", "endereco de faturacao",
        "endereço de faturação", "faturar a", "klantnummer", "klant-nr", "klantcode", "leveringsadres", "verzendadres", "factuuradres",
        "afleveren aan",
    ),
    "ORDER_REF": (
        "votre référence", "votre reference", "votre commande", "votre cde", "votre n° de commande", "votre no de commande", "votre n° commande",
        "votre no commande", "n° cde client", "no cde client", "n° cde", "no cde", "réf cde", "ref cde", "your order", "your reference",
        "your purchase order", "your order no", "your order number", "your po", "po number", "p.o. number", "purchase order no",
        "purchase order number", "customer po", "customer po no", "order ref", "order reference", "ihre bestellung", "ihre bestellnummer",
        "ihre bestell-nr", "ihre bestell nr", "ihre referenz", "kundenbestellung", "bestellnummer kunde", "su pedido", "su referencia",
        "pedido cliente", "n° de pedido cliente", "referencia del cliente", "vostro ordine", "vostro numero ordine", "vostro riferimento",
        "vs ordine", "vs. ordine", "riferimento cliente", "vossa encomenda", "vossa referencia", "vossa referência", "referencia do cliente",
        "referência do cliente", "uw bestelling", "uw referentie", "uw ordernummer",
    ),
    "AFFAIR_NUMBER": (
        "affaire", "n° affaire", "no affaire", "n° d'affaire", "n° daffaire", "dossier", "n° dossier", "no dossier", "réf affaire", "ref affaire",
        "réf dossier", "ref dossier", "project no", "project number", "project ref", "case no", "case number", "file no", "file number",
        "projektnummer", "projekt-nr", "aktenzeichen", "n° expediente", "numero expediente", "n° pratica", "numero pratica",
    ),
}
#: Column labels whose values are not kept.
NEUTRAL_LABELS = (
    "date", "date de cde", "date de commande", "date de réception", "date de reception", "date d'expédition", "date d'expedition", "date d'émission",
    "date d'emission", "date de livraison", "date d'echeance", "date d'échéance", "date prévisionnelle", "date previsionnelle", "date prévue",
    "date prevue", "prévue le", "prevue le", "imprimé le", "imprime le", "edité le", "édité le", "date de livraison estimée",
    "date de livraison estimee", "date livraison", "expedition prevue", "expédition prévue", "modifié le", "modifie le", "page", "type", "code",
    "numéro / date", "numero / date", "n° / date", "no / date", "date document", "document date", "order date", "delivery date", "shipping date",
    "ship date", "due date", "invoice date", "issue date", "expected delivery date", "estimated delivery date", "modified on", "printed on",
    "issued on", "datum", "auftragsdatum", "lieferdatum", "versanddatum", "rechnungsdatum", "fälligkeitsdatum", "faelligkeitsdatum",
    "ausstellungsdatum", "voraussichtliches lieferdatum", "geändert am", "geaendert am", "gedruckt am", "fecha", "fecha de pedido",
    "fecha de entrega", "fecha de envío", "fecha de envio", "fecha de factura", "fecha de vencimiento", "fecha de emisión", "fecha de emision",
    "data", "data ordine", "data consegna", "data spedizione", "data fattura", "data scadenza", "data emissione", "data pedido", "data entrega",
    "data envio", "data fatura", "data vencimento", "data emissão", "data emissao", "remise", "ttc", "ht", "tva", "vat", "prix", "montant", "total",
    "sous-total", "quantite", "quantité", "qte", "qt", "q", "unite", "unité", "u", "u.v.", "uv", "u.v", "p.u", "pu", "pu ht", "p.u.", "puht",
    "prix unit", "prix unitaire", "prix net ht", "prix net", "montant ht", "montant uc", "valeur", "price", "amount", "subtotal", "qty", "quantity",
    "unit", "unit price", "net price", "gross", "net", "value", "discount", "tax", "preis", "menge", "anzahl", "einheit", "stück", "stueck",
    "einzelpreis", "gesamtpreis", "betrag", "rabatt", "mehrwertsteuer", "mwst", "netto", "brutto", "wert", "precio", "importe", "cantidad", "unidad",
    "ud", "uds", "precio unitario", "descuento", "iva", "neto", "bruto", "prezzo", "importo", "quantità", "quantita", "unità", "unita",
    "prezzo unitario", "sconto", "lordo", "preço", "preco", "quantidade", "unidade", "valor", "preço unitário", "preco unitario", "líquido",
    "liquido", "numero piece", "numéro pièce", "numero", "numéro", "n°", "n", "no", "no.", "num", "reference", "référence", "ref.", "réf.", "ref",
    "réf", "designation", "désignation", "article", "code article", "n° article", "no article", "désignation article", "designation article",
    "numéro article", "numero article", "numero article / article client", "numéro article / article client", "commentaire", "commentaires", "poste",
    "position", "pos", "pos.", "description", "item", "part no", "part number", "part", "sku", "model", "model no", "comments", "remarks", "notes",
    "line", "line no", "line item", "artikel", "artikelnummer", "art.-nr", "artikel-nr", "bezeichnung", "beschreibung", "bemerkung", "bemerkungen",
    "modell", "teilenummer", "artículo", "articulo", "codigo articulo", "código artículo", "descripción", "descripcion", "observaciones",
    "comentarios", "posicion", "posición", "modelo", "referencia", "articolo", "codice articolo", "descrizione", "osservazioni", "commenti",
    "posizione", "modello", "artigo", "código artigo", "codigo artigo", "descrição", "descricao", "observações", "observacoes", "comentários",
    "posição", "posicao", "commande", "command", "no commande", "n° commande", "no de commande", "n° de commande", "numero de commande",
    "numéro de commande", "réf commande", "ref commande", "no réf", "no ref", "no facture", "n° facture", "n° de facture", "numero du document",
    "numéro du document", "n° document", "no document", "n° de document", "no de document", "n° doc", "no doc", "date de la commande",
    "date commande", "order no", "order number", "order ref", "document no", "document number", "doc no", "invoice no", "invoice number", "quote no",
    "quote number", "quotation no", "quotation number", "number", "bestellnummer", "bestell-nr", "bestell nr", "auftragsnummer", "auftrag-nr",
    "auftrags-nr", "dokumentnummer", "dokument-nr", "rechnungsnummer", "rechnung-nr", "rg-nr", "angebotsnummer", "angebot-nr", "n° pedido",
    "no pedido", "numero pedido", "número pedido", "n° factura", "n° documento", "n° presupuesto", "n° de pedido", "n° de factura",
    "n° de documento", "n° ordine", "numero ordine", "n° fattura", "n° preventivo", "n° di ordine", "n° di fattura", "n° encomenda",
    "numero encomenda", "número encomenda", "n° fatura", "n° orcamento", "ordernummer", "bestelnummer", "factuurnummer", "documentnummer", "version",
    "rev", "rev.", "indice", "ind", "ind.", "réf devis", "ref devis", "devis", "quotation", "n° devis", "no devis", "votre n°", "notre n°",
    "nos refs", "nos refs.", "nos références", "nos references", "n° cde interne", "no cde interne", "n° cde interne fournisseur", "n° ar", "no ar",
    "numéro ar", "numero ar", "téléphone", "telephone", "tel", "tél", "phone", "e-mail", "email", "mail", "fax", "telecopie", "télécopie",
    "fonction", "function", "mode", "mode d'expédition", "mode d'expedition", "mode de livraison", "mode de paiement", "mode de règlement",
    "mode de reglement", "mode de réglement", "cond. de règlement", "cond. de reglement", "conditions de règlement", "conditions de reglement",
    "conditions de livraison", "conditions de paiement", "condition d'expédition", "condition d'expedition", "incoterm", "incoterms",
    "incoterm 2020", "terms of payment", "terms", "payment terms", "delivery terms", "secteur", "secteur commercial", "destination", "destinataire",
    "destinateur", "expediteur", "expéditeur", "etat", "état", "statut", "status", "lig", "ligne", "lieu", "lieu de livraison", "mission",
    "vos refs", "vos refs.", "vos references", "vos références", "frais", "fees", "delai", "délai", "delivery", "echeance", "échéance", "devise",
    "currency", "monnaie", "pays d'origine", "pays origine", "country of origin", "code douanier", "code douane", "tariff code",
)
#: Capitalised words beside a name that are no part of it, without accents.
PERSON_NOISE = (
    "monsieur", "madame", "mademoiselle", "mr", "mme", "mlle", "monsieur,", "madame,", "telephone", "tel", "fax", "email", "mail", "adresse",
    "ville", "code", "postal", "pays", "rue", "avenue", "boulevard", "place", "page", "pages", "ligne", "lignes", "section", "colonne", "reference",
    "numero", "date", "heure", "jour", "mois", "annee", "tarif", "prix", "quantite", "remise", "montant", "valeur", "total", "totaux", "somme",
    "sous-total", "net", "ht", "ttc", "tva", "identification", "identifiant", "ident", "ident.", "n", "intracom", "intracommunautaire",
    "intracommunautaires", "vat", "siret", "siren", "rcs", "rib", "iban", "bic", "ape", "capital", "social", "actions", "naf", "fr", "de", "en",
    "es", "it", "pt", "uk", "be", "nl", "designation", "description", "article", "articles", "lot", "facturation", "livraison", "commande", "client",
    "fournisseur", "qte", "unite", "delai", "delais", "service", "responsable", "delegue", "interlocuteur", "contact", "acheteur", "vendeur",
    "destinataire", "expediteur", "transporteur", "kbis", "simplifiee", "anonyme", "responsabilite", "limitee", "individuelle", "auto",
    "entrepreneur", "gerant", "president", "presidente", "directeur", "directrice", "votre", "notre", "vos", "nos", "ce", "cette", "ces", "le", "la",
    "les", "un", "une", "des", "du", "bonjour", "bonsoir", "cordialement", "sincerement", "salutations", "veuillez", "merci", "remerciements",
    "conditions", "generales", "particulieres", "garantie", "vente", "ventes", "achat", "achats", "paiement", "reglement", "echeance", "validite",
    "incoterm", "incoterms", "consignation", "reservation", "compte", "comptable", "comptabilite", "phone", "address", "city", "country", "line",
    "column", "number", "time", "day", "month", "year", "price", "quantity", "discount", "amount", "value", "subtotal", "gross", "tax", "item",
    "items", "billing", "shipping", "delivery", "order", "customer", "supplier", "vendor", "buyer", "seller", "carrier", "subject", "recipient",
    "sender", "issuer", "shipped", "billed", "issued", "delivered", "payment", "due", "invoice", "shipment", "responsible", "manager", "purchase",
    "sales", "office", "department", "warehouse", "telefon", "telefax", "anschrift", "stadt", "land", "konto", "kunde", "lieferant", "rechnung",
    "bestellung", "betrag", "menge", "preis", "artikel", "gesamt", "summe", "datum", "stand", "kennzeichen", "nummer", "geschaeftsfuehrer",
    "geschaftsfuhrer", "vorsitzender", "vorstand", "aufsichtsrats", "aufsichtsrat", "sitz", "gesellschaft", "mode", "type", "categorie", "statut",
    "etat", "base", "documents", "document", "informations", "remarques", "notes", "from", "to", "via", "by", "on", "in", "at", "particularites",
    "qty", "unit", "uom", "pcs", "pc", "ea", "kg", "lb", "et", "and", "und", "or", "ou", "nonobstant", "ref", "tél", "représentant", "representant",
    "assistant", "assistante", "commercial", "commerciale", "comptabilité", "téléphone", "particulières", "spring", "automation",
)
