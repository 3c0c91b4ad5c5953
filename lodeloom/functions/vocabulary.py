"""Fixed values of aspect extraction: anchor phrases, search windows, words that are no entities."""

# Fixed values -----------------------------------------------------------------
ROLE_ANCHORS = {
    "prob_sub": [
        "the main problem is", "we are experiencing an issue with", "I am reporting a problem", "there is an error in the system",
        "the system has failed to work", "I am contacting you to report", "we have encountered an issue", "I am writing to report a problem",
        "a crash occurred in our software", "we detected unauthorized access", "there was a security breach",
        "das Hauptproblem ist", "wir haben ein Problem mit", "ich melde ein Problem", "es gibt einen Fehler", "das System funktioniert nicht mehr",
        "ich schreibe um ein Problem zu melden", "wir haben ein Problem festgestellt", "es kam zu einem unerwarteten Fehler",
        "unerlaubter Zugriff wurde festgestellt",
    ],
    "prob_statement": [
        "the system is completely down and affecting all users", "we are unable to access our data and operations are halted",
        "the crash happened during a critical operation causing significant delays",
        "medical data has been compromised and patient records are at risk",
        "the security breach is affecting all hospital systems and data",
        "the software keeps crashing and the issue continues to persist",
        "our campaign metrics are declining significantly despite all adjustments",
        "data synchronization between systems is failing and blocking operations",
        "the integration is broken and the entire business process is blocked",
        "unauthorized access was detected in the medical records system",
        "the platform is experiencing severe performance degradation affecting workflows",
        "investment projections are inaccurate due to data inconsistencies",
        "the digital tools crashed and critical data access is disrupted",
        "das System ist vollstandig ausgefallen und betrifft alle Benutzer",
        "wir konnen nicht auf unsere Daten zugreifen und der Betrieb ist blockiert",
        "der Absturz geschah wahrend eines kritischen Vorgangs und verursacht Verzogerungen",
        "medizinische Daten wurden kompromittiert und Patientendaten sind gefahrdet",
        "die Sicherheitsverletzung betrifft alle Systeme des Krankenhauses",
        "die Software sturzt standig ab und das Problem besteht weiterhin fort",
        "unsere Kampagnenmetriken sinken erheblich trotz aller Anpassungen",
        "unerlaubter Zugriff auf das medizinische Datensystem wurde festgestellt",
        "die digitalen Werkzeuge sind abgestuerzt und der Datenzugriff ist gestort",
    ],
    "cause": [
        "the root cause is", "this happened because", "the issue is due to", "triggered by a phishing attack",
        "caused by incompatible software updates", "this might be related to", "the probable cause is", "possibly due to a software bug",
        "the problem stems from", "this could be due to",
        "die Ursache ist", "das Problem entstand durch", "ausgelost durch", "verursacht durch inkompatible Updates",
        "aufgrund von Softwarekonflikten", "konnte auf zuruckzufuhren sein", "wahrscheinlich aufgrund einer Serveruberlastung",
        "die mogliche Ursache ist",
    ],
    "action_taken": [
        "we have already tried to fix it", "I have restarted the system", "we attempted to resolve by restarting",
        "despite our efforts to resolve", "we have updated the software but the problem persists", "I cleared the cache and restarted",
        "we ran antivirus scans", "passwords have been reset", "we applied software updates without success",
        "wir haben bereits versucht", "ich habe das System neu gestartet", "wir haben versucht das Problem zu beheben",
        "trotz unserer Bemuhungen bleibt das Problem", "wir haben die Software aktualisiert",
        "ich habe den Cache geleert und neu gestartet", "Systemupdates wurden durchgefuhrt", "Passworter wurden zuruckgesetzt",
    ],
    "urgency": [
        "this is urgent and needs immediate attention", "we need immediate assistance now", "critical issue affecting business operations",
        "production system is down", "data loss is occurring",
        "dringend Unterstutzung benotigt", "kritisches Problem betrifft den Betrieb", "sofortige Hilfe benotigt", "Produktion ist ausgefallen",
    ],
}
ROLE_WINDOWS = {"prob_sub": (1, 3), "prob_statement": (1, 4), "cause": (1, 4), "action_taken": (2, 6), "urgency": (2, 99)}
#: Words that begin sentences and are no entities.
OPENERS = [
    "The", "This", "These", "Those", "There", "Here", "Dear", "Hello", "Please", "Thank", "Kindly", "Additionally", "Furthermore", "However",
    "Therefore", "Moreover", "Although", "Despite", "Meanwhile", "Immediate", "Currently", "Recently", "Already", "After", "Before", "During",
    "Since", "While", "When", "Where", "What", "Which", "Who", "How", "Why", "If", "As", "So", "We", "Our", "My", "Your", "Their", "Its",
    "Sehr", "Liebe", "Bitte", "Danke", "Leider", "Trotz", "Obwohl", "Wegen", "Falls", "Wenn", "Auch", "Noch", "Schon", "Bereits", "Jedoch",
    "Daher", "Deshalb", "Damit", "Somit", "Zudem", "Ausserdem", "Trotzdem", "Besonders", "Insbesondere",
]
#: Other words that are no entities (with the openers).
STOPWORDS = [
    "you", "he", "she", "it", "they", "that", "an", "of", "in", "on", "at", "by", "for", "with", "from", "to", "into", "through", "above",
    "below", "between", "among", "and", "or", "but", "yet", "nor", "not", "no", "yes", "also", "just", "still", "again", "once", "often",
    "always", "never", "very", "too", "quite", "rather", "more", "most", "less", "least", "thus", "hence", "immediately", "overall",
    "finally", "initially", "subsequently", "hi", "best", "regards", "sincerely", "greetings", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "need", "let",
    "make", "get", "give", "take", "keep", "help",
    "ich", "wir", "sie", "er", "es", "ihr", "uns", "euch", "ihnen", "sich", "der", "die", "das", "ein", "eine", "einem", "einer", "eines",
    "den", "dem", "des", "und", "oder", "aber", "als", "ob", "da", "weil", "dass", "mit", "von", "zu", "auf", "fur", "durch", "uber", "unter",
    "nach", "vor", "bei", "bis", "seit", "ohne", "gegen", "um", "statt", "wahrend", "ist", "sind", "war", "waren", "wird", "werden", "wurde",
    "wurden", "hat", "haben", "hatte", "hatten", "kann", "konnen", "konnte", "konnten", "muss", "mussen", "soll", "sollen", "darf", "durfen",
    "gerne", "bald", "immer", "nie", "oft", "mehr", "weniger", "alle", "keine", "kein", "nicht", "nur", "ihrem", "ihrer", "ihres", "ihren",
    "ihre", "geehrte", "hallo", "kundensupport",
]
ENTITY_PATTERNS = [
    r"\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z0-9]*)*\s+(?:v\.?\s*)?\d+(?:\.\d+)*\b",
    r"\b[A-Z][a-z]+[A-Z][a-zA-Z0-9]+\b",
    r"\b[A-Z]{2,6}\b",
    r"\b[A-Z][a-zA-Z]+-[A-Z]?[a-zA-Z]+\b",
]
CAPITALISED, GERMAN_NOUN, PRODUCT_LIKE = r"\b[A-Z][a-zA-Z]{3,}\b", r"\b[A-Z][a-z]{4,}\b", r"\d|[a-z][A-Z]"
# -------------------------------------------------------------------------------
