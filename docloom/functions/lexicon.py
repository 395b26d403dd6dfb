"""Word lists and patterns that the text functions use."""

# Contract terms, French to English.
TERMS = {
    "montant": "amount",
    "échéance": "due date",
    "livraison": "delivery",
    "pénalité": "penalty",
    "date": "date",
    "contrat": "contract",
    "signature": "signature",
    "avenant": "amendment",
    "résiliation": "termination",
    "paiement": "payment",
    "garantie": "warranty",
    "obligation": "obligation",
    "clause": "clause",
    "parties": "parties",
    "objet du contrat": "scope of the contract",
    "livraisons": "deliverables",
    "frais": "fees",
    "confidentialité": "confidentiality",
    "propriété intellectuelle": "intellectual property",
    "clause de résiliation": "termination clause",
    "conformité légale": "legal compliance",
    "support technique": "technical support",
    "responsabilités": "responsibilities",
    "délais": "milestones",
    "résolution des litiges": "dispute resolution",
    "force majeure": "force majeure",
    "accès aux données": "data access",
    "sécurité des données": "data security",
    "licence": "license",
    "exclusivité": "exclusivity",
    "durée du contrat": "contract term",
    "résiliation pour cause": "termination for cause",
}

# Words that make a question one about dates.
DATE_WORDS = [
    "date", "échéance", "délai", "terme", "expire", "expiration", "calendrier",
    "planning", "horaire", "jour", "mois", "année", "trimestre", "semestre",
    "période", "durée", "temps", "chronologie", "deadline", "livraison",
    "anniversaire", "signature", "préavis",
    "calendar", "schedule", "day", "month", "year", "quarter",
    "semester", "period", "duration", "time", "timeline", "delivery",
    "anniversary", "notice",
]

# Clause types and their patterns; the first that matches counts.
CLAUSE_TYPES = {
    "confidentialité": r"\b(confidential|confidentialité|non[\s-]disclosure|secret|divulgation)\b",
    "résiliation": r"\b(termin|résili|cancel|end.*agreement|fin.*contrat)\w*\b",
    "force majeure": r"\b(force\s+majeure|act\s+of\s+god|événement.*extérieur)\b",
    "indemnisation": r"\b(indemn|compensat|dommages|damages)\w*\b",
    "limitation de responsabilité": r"\b(limit\w*\s+(de\s+)?(responsabilit|liabilit)|liabilit\w*\s+limit)\b",
    "propriété intellectuelle": r"\b(intellect\w*\s+propert|propr\w*\s+intellect|ip\s+rights|brevet|patent|copyright|droit.*auteur)\b",
    "garanties": r"\b(warrant|garantie|represent\w*)\b",
    "paiement": r"\b(pay\w*|paiement|compensat\w*|prix|price|fee|frais)\b",
    "durée": r"\b(term|durée|period|période)\b",
    "résolution des litiges": r"\b(disput|litige|arbitr\w*|médiati\w*|juridic\w*|tribuna\w*|court)\b",
    "définitions": r"\b(défini\w+|signifi\w+|mean\w+|terme\w*)\b",
    "cession": r"\b(assign\w*|cessi\w*|transf[ée]r\w*)\b",
    "non-concurrence": r"\b(non[\s-]comp[eé]t|concurren\w+)\b",
    "modification": r"\b(modifi\w*|amend\w*|chang\w*)\b",
}

# Months, for dates in text.
MONTHS_EN = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MONTHS_FR = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]
SHORT_EN = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec"]
SHORT_FR = ["jan", "fév", "mar", "avr", "mai", "juin", "juil", "août", "sept", "oct", "nov", "déc"]

# Words of question features.
IMPERATIVES = ["donne", "liste", "indique", "montre", "fournis", "trouve"]
MODALS = ["pourrait", "devrait", "faudrait", "serait", "peux-tu", "pouvez-vous"]
COMPARATIVES = ["compare", "différence", "similitude", "comme", "plus que", "moins que"]
WHAT_IS = ["qu'est-ce", "quel est", "quels sont", "quelle est", "quelles sont"]
REQUESTS = ["peux-tu", "pouvez-vous", "pourriez-vous"]

# Patterns of questions that retrieval answers, and of those that a model answers alone.
RAG_PATTERNS = [
    r"quand", r"quelle.*date", r"date.*limite", r"échéance", r"délai", r"\bà quelle date\b", r"calendrier", r"planning", r"agenda", r"quelles sont les dates",
    r"quel.*montant", r"\bcombien\b", r"prix", r"coût", r"pénalité", r"indemnité", r"garantie", r"caution", r"taux", r"pourcentage", r"euro|EUR|€", r"dollar|\$",
    r"montant.*total", r"budget", r"devis", r"facturation", r"acompte",
    r"quelles obligations", r"(qui|que) doit", r"responsabilité", r"responsabilités", r"contraintes", r"quelles exigences", r"quelles sont les modalités",
    r"(qui|quoi|que) fournir", r"livrable", r"attentes", r"requis", r"conformité",
    r"quelles? spécifications", r"caractéristiques techniques", r"performance requise", r"niveau de service", r"SLA", r"quelle puissance", r"quels critères",
    r"quelles normes", r"annexe technique", r"référentiel", r"standards",
    r"extrai(s|t|re)", r"liste", r"montre", r"identifie", r"donne", r"fourni(s|t|r)", r"quel article", r"récupère", r"où (est|sont|se trouve)",
    r"où est défini", r"dans quel(le)? (article|annexe|section)", r"combien d[e']", r"quel est le (nombre|montant|taux|délai)",
    r"quelle est la (liste|procédure|durée|date|modalité)",
    r"compare.*(contrat|clause)", r"différence.*(entre|avec)", r"quelles? sont les différences", r"en quoi diffère",
]
LLM_PATTERNS = [
    r"\btradui[a-z]*\b", r"\brédige[a-z]*\b", r"\bmodèle\b", r"\bcourier\b", r"\bavenant\b", r"\bpropose[a-z]*\b", r"\bcrée\b", r"\bélabore\b",
    r"\bdéveloppe\b", r"\bcréation\b",
    r"résum[eé]", r"reformule", r"simplifie", r"présente", r"draft", r"brouillon", r"comment rédiger", r"plan de", r"structure de", r"format de", r"template",
    r"écris", r"rédaction", r"formule", r"génère",
    r"analyse", r"évalue", r"interprète", r"impact", r"risque", r"avantage", r"recommande", r"suggestion", r"conseille", r"stratégie", r"approche",
    r"implications", r"conséquence", r"pertinence", r"valide", r"vérifie", r"compare avec", r"standard", r"bonne pratique", r"conforme à", r"opinion",
    r"calcule", r"estime", r"prévois", r"serait", r"pourrait", r"devrait",
    r"comment (faire|gérer|mettre en place|optimiser)", r"processus de", r"procédure pour", r"étapes? pour", r"démarche pour", r"méthodologie", r"workflow",
    r"méthode de", r"organiser", r"structurer", r"définir un", r"améliorer", r"optimiser", r"comment élaborer", r"comment développer", r"comment concevoir",
    r"conseil", r"avis", r"penses-tu", r"suggère", r"meilleure façon", r"recommandes-tu", r"quelle approche", r"pratiques", r"stratégies?", r"solution",
    r"alternatives?", r"scenario", r"options?", r"justifie", r"selon toi", r"ton opinion", r"que préconises-tu", r"comment aborder",
]

OBLIGATIONS = ["shall", "must", "will", "agree", "represent", "warrant", "indemnify", "liability"]

# Lines that are titles.
TITLE_PATTERNS = [
    r"^#+\s+\**[A-Za-z0-9]",
    r"^ARTICLE\s+[IVXLCDM]+\s*[:\.]",
    r"^SECTION\s+[0-9]+\s*[:\.]",
    r"^CHAPTER\s+[0-9]+\s*[:\.]",
    r"^ANNEXE?\s+[A-Z]:",
    r"^APPENDIX\s+[A-Z]:",
    r"^[0-9]+(\.[0-9]+)*\s+[A-Z]",
    r"^\*\*[A-Z]",
    r"^[A-Z][A-Z\s]+:$",
    r"^[A-Z][A-Z\s]{1,30}$",
    r"^#{1,6}\s+.*$",
    r"^#{1,6}$",
    r"^(ARTICLE|Section|Chapter|§)\s+\d+(\.\d+)*",
    r"^(\d+\.)+\d*\s+[A-Z][a-z]+.*$",
]

# Lines that begin a clause, define a term, belong to a list, refer elsewhere, or begin a section.
CLAUSE_STARTS = [
    r"^(\d+(?:\.\d+)*)\s+[A-Z]", r"^Article\s+\d+", r"^Section\s+\d+", r"^Clause\s+\d+", r"^ARTICLE\s+[IVX]+", r"^[A-Z\s]{5,}:", r"WHEREAS", r"NOW, THEREFORE",
]
DEFINITIONS = [r'^\s*".*"\s+is|means|shall mean', r'^\s*".*"\s+-\s+', r'^\s*[""].*[""] i(?:s|s\s+a|s\s+the|s\s+defined\s+as)', r'^\s*[Tt]he\s+term\s+[""].*[""]']
LIST_ITEMS = [
    r"^\s*(\([a-z]\)|\([ivx]+\)|[a-z]\)|[ivxlcdm]+\)|\([0-9]+\)|[0-9]+\)|\(\d+\.\d+\))", r"^\s*(-|\*|•|‣|◦|⁃|∙)\s", r"^\s*([A-Z]|[a-z]|[ivxlcdm]+|[IVXLCDM]+)\.(\s|$)",
    r"^\s*([a-z]|[A-Z]|[0-9])\s", r"^\s*\d+\.\d+\s",
]
LIST_TYPES = {
    "alpha": r"^\s*\([a-z]\)|^\s*[a-z]\)",
    "roman": r"^\s*\([ivx]+\)|^\s*[ivxlcdm]+\)",
    "numeric": r"^\s*\([0-9]+\)|^\s*[0-9]+\)",
    "bullet": r"^\s*(-|\*|•)",
}
# References to other parts, and the starts of sections by depth.
REFERRING = [
    r"pursuant to (?:Section|Article|Clause) (\d+(?:\.\d+)*)",
    r"as defined in (?:Section|Article|Clause) (\d+(?:\.\d+)*)",
    r"in accordance with (?:Section|Article|Clause) (\d+(?:\.\d+)*)",
    r"as per (?:Section|Article|Clause) (\d+(?:\.\d+)*)",
    r"according to (?:Section|Article|Clause) (\d+(?:\.\d+)*)",
    r"as set forth in (?:Section|Article|Clause) (\d+(?:\.\d+)*)",
    r"as specified in (?:Section|Article|Clause) (\d+(?:\.\d+)*)",
    r"as stipulated in (?:Section|Article|Clause) (\d+(?:\.\d+)*)",
]
SECTION_BREAKS = [
    r"^\d+\.\s",
    r"^\d+\.\d+\.\s",
    r"^\d+\.\d+\.\d+\.\s",
]

# Words and patterns of lines with legal content.
SHORT_LINE_WORDS = ["date", "signature", "between", "and", "list", "exhibit", "therefore", "contract", "shall", "mean", "defined", "pursuant", "under", "according", "damage", "payment"]
LEGAL_WORDS = [
    "notwithstanding", "shall be", "exclusive remedy", "sole and exclusive", "right to terminate", "limitation of liability", "indemnify", "warranty", "warranties", "liabilities",
    "liability", "remedies", "remedy", "disclaims", "disclaim", "claims", "claim", "damages", "damage", "breach", "termination", "terminate", "force majeure",
    "intellectual property", "confidential", "liquidated damages", "penalties", "penalty", "shall", "obligation", "obligations", "responsibility", "responsibilities",
    "rights", "right", "terms", "conditions", "provisions", "stipulations", "agreement", "contract", "hereof", "herein", "thereof", "therein", "delivery", "deliver",
    "payment", "pay", "price", "fee", "fees", "delay", "delays", "timely", "schedule", "schedules", "deadline", "milestones", "milestone", "completion", "complete",
    "acceptance", "accepts", "accept", "approved", "approve", "approval", "rejected", "reject", "rejection", "dispute", "disputes", "resolution", "test", "testing",
    "inspection", "inspect", "audit", "review", "pursuant", "accordance", "compliance", "comply", "applicable", "indemnification", "indemnified", "indemnities", "insurance",
    "insured", "coverage", "purchaser", "supplier", "parties",
]
# References to clauses, exclusions, conditions, duties, and documents or payments.
LEGAL_PATTERNS = [
    r"clause\s+\d+(\.\d+)?",
    r"article\s+\d+(\.\d+)?",
    r"section\s+\d+(\.\d+)?",
    r"pursuant to",
    r"in accordance with",
    r"subject to",
    r"appendix [a-z]",
    r"annex [a-z]",
    r"not be liable",
    r"no liability",
    r"shall not",
    r"exclude[sd]?",
    r"except",
    r"exempted",
    r"limitation",
    r"limited to",
    r"restrict(ed|ion)",
    r"waive[sd]?",
    r"waiver",
    r"if\s+.*\s+(shall|may|must|will|is|are)\s+",
    r"(shall|may|must|will)\s+.*\s+(if|unless|until|provided that)",
    r"^(the\s+)?(purchaser|supplier|contractor|client|party|parties)\s+(shall|may|will|must)",
    r"(documents?|delivery|payment|invoice|fee|compensation|reimbursement)",
]

# Words of the rules that correct a route.
CREATION = ["rédige", "génère", "crée", "élabore", "propose", "modèle", "écris", "formule", "développe", "prépare", "établis", "conçois", "suggère", "améliore", "plan", "amélioration", "stratégie", "argumentaire"]
EXTRACTION = [
    "liste", "extrais", "extrait", "extraction", "trouve", "donne", "montre", "quand", "combien", "où", "quel", "identifie", "récupère", "recense", "analyse", "quelles sont",
    "indique", "localise", "détermine", "examine", "énumère", "sélectionne", "cherche", "recherche", "explore",
]
STRATEGY = ["stratégie", "approche", "comment gérer", "comment réagir", "adopter face"]

# Where a chunk names its section, the first that matches; then the shapes of chapter titles.
CHUNK_SECTIONS = [
    r"[-\*]\s*(\d+(?:\.\d+)*)", r"^(\d+(?:\.\d+)*)\s", r"Article\s+(\d+(?:\.\d+)*)", r"Section\s+(\d+(?:\.\d+)*)", r"Clause\s+(\d+(?:\.\d+)*)",
    r"^\s*(\([a-z]\)|\([ivx]+\)|[a-z]\)|[ivxlcdm]+\))",
]
CHAPTER_SHAPES = r"^\d+\.\s+[A-Z]|^[A-Z][a-z]+\s+\d+|^[-\*]\s*\d+\.\d+\s+[A-Z]"

# Lines that begin a section: what they must not begin with, then (pattern, group of the number, group of the title), the first that matches.
NO_SECTION = r"^(?:page|version|document|file|date|time|author|status|confidential|proprietary|copyright|all rights reserved|©|\(c\)|\[|\]|\||\+|=|_|\s*$)"
SHOUTED = r"[A-Z0-9\s'\-àáâäèéêëìíîïòóôöùúûüçÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜÇ_,;:()]+"
SECTION_STARTS = [
    (r"^#+\s*\*\*(\d+(?:\.\d+)*)\*\*\s+(.+)$", 1, 2),
    (r"^\*\*(\d+(?:\.\d+)*)\*\*\s+([A-Z].*)$", 1, 2),
    (r"^-\s*(\d+(?:\.\d+)+)\s*(.*?)$", 1, 2),
    (r"^(?:[#*-]+\s*)?(\d+)\.\s+(.*?)$", 1, 2),
    (r"^#+\s*\*\*(\d+)\.\s+(.*?)\*\*$", 1, 2),
    (r"^#+\s*(\d+(?:\.\d+)+)\s*(.*?)$", 1, 2),
    (r"^\*\*Titre du chapitre\*\*:\s*\*\*(\d+(?:\.\d+)*)\.?\s+(.*?)\*\*", 1, 2),
    (r"^#+\s*([A-Z\s]+)\s*(\d+)\.?$", 2, 1),
    (r"^#+\s*(\d+)\.\s*([A-Z\s]+)$", 1, 2),
    (r"^#+\s*\*\*([A-Z\s]+)(\d+)\.?\*\*$", 2, 1),
    (rf'^"{{0,3}}#+\s*\*\*(\d+(?:\.\d+)*)\*\*\s+({SHOUTED})"{{0,3}}$', 1, 2),
    (rf'^"{{0,3}}#+\s*\*\*(\d+(?:\.\d+)*)\s+({SHOUTED})\*\*"{{0,3}}$', 1, 2),
    (rf'^"{{0,3}}\*\*(\d+(?:\.\d+)*)\*\*\s+({SHOUTED})"{{0,3}}$', 1, 2),
    (r"^(\d+\s+\d+)\s*(.*?)$", 1, 0),
    (r"^(\d+(?:\.\d+)*)\s*(.*?)$", 1, 2),
]

# Signs of a table in a text (one row of three columns is enough of a sign), lines of a table, and white space.
TABLES = [
    r"[\|\+][-\+]+[\|\+]",
    r"\|.*\|.*\|",
    r"\t.*\t",
    r"(?:\s{2,}[^\s]+){3}",
    r"^[^:]+:\s+[^:]+(?:\s{2,}[^:]+:\s+[^:]+)+$",
]
TABLE_LINES = [
    r"^\s*\|.*\|\s*$",
    r"^\s*\+[-+]+\+\s*$",
    r"^\s*[-]+\s*$",
    r"^\s*[_]+\s*$",
    r"^\s*[=]+\s*$",
    r"^\s*[A-Za-z0-9\s]+\s*\|\s*[A-Za-z0-9\s]+\s*$",
    r"^\s*[A-Za-z0-9\s]+\s*[,;]\s*[A-Za-z0-9\s]+\s*$",
    r"^\s*\|.*$",
    r"^\s*\+.*$",
    r"^\s*[-_=]+\s*$",
]
BLANKS = [" ", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0", "\u2003", "\u2009", "\u202f", "\u3000"]

#: Lines of an agreement in seven languages, by language and kind (pages of contracts name parties, dates and signatures so).
AGREEMENT_LINES = {
    "fr": {
        "signature": [r"^(?:Signé|Fait à|À|En foi de quoi|Par les présentes|En conséquence|En foi de quoi|En conséquence de quoi)\s*:?\s*$"],
        "date": [r"^(?:Fait à|À|Le|En date du|Le présent contrat est établi le)\s+.+,\s+(?:le\s+)?(\d{1,2}\s+\w+\s+\d{4}|\d{1,2}/\d{1,2}/\d{4})"],
        "party": [r"^Entre\s+les\s+soussignés\s*:", r"^D'une\s+part\s*:", r"^D'autre\s+part\s*:", r"^Entre\s+:", r"^D'une\s+part\s*,\s*([^,]+)", r"^D'autre\s+part\s*,\s*([^,]+)", r"^Le\s+client\s*:", r"^Le\s+prestataire\s*:", r"^La\s+société\s*:", r"^L'entreprise\s*:"],
    },
    "en": {
        "signature": [r"^(?:Signed|Done at|In witness whereof|By these presents|In consideration|In witness whereof|In consideration whereof)\s*:?\s*$"],
        "date": [r"^(?:Done at|At|On|Dated|This agreement is made on)\s+.+,\s+(?:the\s+)?(\d{1,2}\s+\w+\s+\d{4}|\d{1,2}/\d{1,2}/\d{4})"],
        "party": [r"^Between\s*:", r"^Party\s+A\s*:", r"^Party\s+B\s*:", r"^First\s+Party\s*:", r"^Second\s+Party\s*:", r"^The\s+Client\s*:", r"^The\s+Provider\s*:", r"^The\s+Company\s*:", r"^The\s+Business\s*:"],
    },
    "es": {
        "signature": [r"^(?:Firmado|Hecho en|En fe de lo cual|Por las presentes|En consideración|En fe de lo cual|En consideración de lo cual)\s*:?\s*$"],
        "date": [r"^(?:Hecho en|En|El|Con fecha|El presente contrato se celebra el)\s+.+,\s+(?:el\s+)?(\d{1,2}\s+\w+\s+\d{4}|\d{1,2}/\d{1,2}/\d{4})"],
        "party": [r"^Entre\s+los\s+abajo\s+firmados\s*:", r"^Por\s+una\s+parte\s*:", r"^Por\s+otra\s+parte\s*:", r"^Entre\s+:", r"^Por\s+una\s+parte\s*,\s*([^,]+)", r"^Por\s+otra\s+parte\s*,\s*([^,]+)", r"^El\s+cliente\s*:", r"^El\s+proveedor\s*:", r"^La\s+empresa\s*:", r"^La\s+sociedad\s*:"],
    },
    "de": {
        "signature": [r"^(?:Unterschrieben|Geschehen zu|Zu\s+Urkund\s+dessen|Durch\s+diese\s+Urkunde|In\s+Erwägung|Zu\s+Urkund\s+dessen|In\s+Erwägung\s+dessen)\s*:?\s*$"],
        "date": [r"^(?:Geschehen zu|Zu|Am|Datiert|Dieser\s+Vertrag\s+wird\s+geschlossen\s+am)\s+.+,\s+(?:den\s+)?(\d{1,2}\.\s+\w+\s+\d{4}|\d{1,2}\.\d{1,2}\.\d{4})"],
        "party": [r"^Zwischen\s*:", r"^Einerseits\s*:", r"^Andererseits\s*:", r"^Zwischen\s+:", r"^Einerseits\s*,\s*([^,]+)", r"^Andererseits\s*,\s*([^,]+)", r"^Der\s+Kunde\s*:", r"^Der\s+Anbieter\s*:", r"^Die\s+Firma\s*:", r"^Das\s+Unternehmen\s*:"],
    },
    "it": {
        "signature": [r"^(?:Firmato|Fatto a|In\s+fede\s+di\s+che|Per\s+le\s+presenti|In\s+considerazione|In\s+fede\s+di\s+che|In\s+considerazione\s+di\s+che)\s*:?\s*$"],
        "date": [r"^(?:Fatto a|A|Il|In\s+data|Il\s+presente\s+contratto\s+è\s+stipulato\s+il)\s+.+,\s+(?:il\s+)?(\d{1,2}\s+\w+\s+\d{4}|\d{1,2}/\d{1,2}/\d{4})"],
        "party": [r"^Tra\s+i\s+sottoscritti\s*:", r"^Da\s+una\s+parte\s*:", r"^Dall'altra\s+parte\s*:", r"^Tra\s+:", r"^Da\s+una\s+parte\s*,\s*([^,]+)", r"^Dall'altra\s+parte\s*,\s*([^,]+)", r"^Il\s+cliente\s*:", r"^Il\s+fornitore\s*:", r"^La\s+società\s*:", r"^L'impresa\s*:"],
    },
    "pt": {
        "signature": [r"^(?:Assinado|Feito em|Em\s+testemunho\s+do\s+que|Por\s+estas\s+presentes|Em\s+consideração|Em\s+testemunho\s+do\s+que|Em\s+consideração\s+do\s+que)\s*:?\s*$"],
        "date": [r"^(?:Feito em|Em|O|Com\s+data|O\s+presente\s+contrato\s+é\s+celebrado\s+em)\s+.+,\s+(?:o\s+)?(\d{1,2}\s+\w+\s+\d{4}|\d{1,2}/\d{1,2}/\d{4})"],
        "party": [r"^Entre\s+os\s+abaixo\s+assinados\s*:", r"^Por\s+uma\s+parte\s*:", r"^Por\s+outra\s+parte\s*:", r"^Entre\s+:", r"^Por\s+uma\s+parte\s*,\s*([^,]+)", r"^Por\s+outra\s+parte\s*,\s*([^,]+)", r"^O\s+cliente\s*:", r"^O\s+fornecedor\s*:", r"^A\s+empresa\s*:", r"^A\s+sociedade\s*:"],
    },
    "nl": {
        "signature": [r"^(?:Ondertekend|Gedaan te|Ten\s+blijke\s+waarvan|Bij\s+deze|In\s+overweging|Ten\s+blijke\s+waarvan|In\s+overweging\s+waarvan)\s*:?\s*$"],
        "date": [r"^(?:Gedaan te|Te|Op|Gedateerd|Dit\s+contract\s+wordt\s+gesloten\s+op)\s+.+,\s+(?:de\s+)?(\d{1,2}\s+\w+\s+\d{4}|\d{1,2}-\d{1,2}-\d{4})"],
        "party": [r"^Tussen\s*:", r"^Enerzijds\s*:", r"^Anderzijds\s*:", r"^Tussen\s+:", r"^Enerzijds\s*,\s*([^,]+)", r"^Anderzijds\s*,\s*([^,]+)", r"^De\s+klant\s*:", r"^De\s+aanbieder\s*:", r"^Het\s+bedrijf\s*:", r"^De\s+onderneming\s*:"],
    },
}

#: What a model that reads page images adds to a page: marks between pages and remarks of its own.
PAGE_REMARKS = [r"---\s*Page \d+.*?---", r"The (scanned page|document|image) (shows|is|appears).*?\n", r"This document appears to be.*?\n", r"The text is.*?\n"]
