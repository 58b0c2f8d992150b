"""Fixed values of the rules: word lists, labels and tags that results hang on.

All that is here are values, not logic; ``rules`` and ``names`` build patterns from them.
"""

from __future__ import annotations

# Rule labels to unified labels.
UNIFIED = {
    "DATE": "DATE", "TIME": "TIME", "PHONE": "PHONE", "DOCTOR": "NAME", "AGE": "AGE", "LOCATION": "LOCATION", "RELATION": "FAMILY",
    "IDENTIFICADOR": "ID", "HOSPITAL": "HOSPITAL", "PERSON": "NAME", "EMAIL": "EMAIL", "URL": "URL", "GENERICA": "OTHER",
}

# Labels of annotated corpora and models to unified labels; what isn't here is OTHER.
CORPUS_LABELS = {
    "FECHAS": "DATE", "HORAS": "TIME", "NOMBRE_SUJETO_ASISTENCIA": "NAME", "NOMBRE_PERSONAL_SANITARIO": "NAME", "FAMILIARES_SUJETO_ASISTENCIA": "FAMILY",
    "PROFESION": "PROFESSION", "EDAD_SUJETO_ASISTENCIA": "AGE", "SEXO_SUJETO_ASISTENCIA": "SEX", "CALLE": "LOCATION", "TERRITORIO": "LOCATION", "PAIS": "LOCATION",
    "HOSPITAL": "HOSPITAL", "CENTRO_SALUD": "HOSPITAL", "INSTITUCION": "ORGANIZATION", "NUMERO_TELEFONO": "PHONE", "NUMERO_FAX": "PHONE", "CORREO_ELECTRONICO": "EMAIL",
    "URL_WEB": "URL", "NUMERO_IDENTIF": "ID", "ID_SUJETO_ASISTENCIA": "ID", "ID_CONTACTO_ASISTENCIAL": "ID", "ID_ASEGURAMIENTO": "ID",
    "ID_EMPLEO_PERSONAL_SANITARIO": "ID", "ID_TITULACION_PERSONAL_SANITARIO": "ID", "OTROS_SUJETO_ASISTENCIA": "OTHER",
}

# Unified labels to placeholder tags, tags to their other names.
TAGS = {
    "DATE": "FECHA", "TIME": "HORA", "NAME": "NOMBRE", "PROFESSIONAL": "PROFESIONAL", "FAMILY": "FAMILIAR", "PROFESSION": "PROFESION",
    "AGE": "EDAD", "SEX": "SEXO", "LOCATION": "LUGAR", "HOSPITAL": "HOSPITAL", "ORGANIZATION": "ORGANIZACION", "PHONE": "TELEFONO",
    "EMAIL": "CORREO", "URL": "URL", "ID": "ID", "OTHER": "ANONIMO", "PHI": "ANONIMO",
}
OTHER_TAGS = {
    "NAME": "NOMBRE", "DATE": "FECHA", "TIME": "HORA", "PROFESSIONAL": "PROFESIONAL", "FAMILY": "FAMILIAR", "PROFESSION": "PROFESION", "AGE": "EDAD",
    "SEX": "SEXO", "LOCATION": "LUGAR", "ORGANIZATION": "ORGANIZACION", "PHONE": "TELEFONO", "EMAIL": "CORREO", "ANONYMOUS": "ANONIMO", "OTHER": "ANONIMO",
}

# Fixed value: check letters of national identity numbers, by remainder.
CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

# Months and weekdays in Spanish and Catalan, in the order of the calendar.
MONTHS = (
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre "
    "gener febrer març abril maig juny juliol setembre octubre novembre desembre"
).split()
WEEKDAYS = "lunes martes miércoles miercoles jueves viernes sábado sabado domingo dilluns dimarts dimecres dijous divendres dissabte diumenge".split()

# Top-level domains that make a bare host a URL.
DOMAINS = "com es net org cat eu edu gov info biz".split()

# Words that may not follow a doctor's title.
NOT_AFTER_TITLE = "OI OD HTA EA AP ANM AMC dret dreta drenaje dren droga drogueta dramático drástica".split()

NOT_AFTER_TITLE_LOW = {w.lower() for w in NOT_AFTER_TITLE}

# doctors' titles (the short ones may have a dot), units of age, a country's calling code, what a URL begins with.
TITLES_SHORT = "dr dra drs".split()
TITLES = [*TITLES_SHORT, "doctor", "doctora"]
AGE_UNITS = "año años a".split()
COUNTRY_CODES = ["+34", "0034"]
URL_LEADS = ["http://", "https://", "ftp://", "www."]

# Kinship words in Spanish and Catalan.
KINSHIP = (
    "madre padre hijo hija esposo esposa marido mujer hermano hermana tío tía abuelo abuela nieto nieta sobrino sobrina primo prima cuñado cuñada "
    "suegro suegra yerno nuera pareja cónyuge viejo vieja papá mamá família familia mare fill filla espòs marit dona germà germana oncle tia avi àvia "
    "nét néta nebot neboda cosí cosina cunyat cunyada sogre sogra gendre nora parella cònjuge xicot xicota nòvio nòvia"
).split()

# Towns and districts of Catalonia, then countries of America.
PLACES = [
    "Barcelona", "Hospitalet de Llobregat", "L'Hospitalet", "Badalona", "Terrassa", "Sabadell", "Mataró", "Santa Coloma de Gramenet", "Cornellà de Llobregat",
    "Sant Boi de Llobregat", "Sant Cugat del Vallès", "Manresa", "Rubí", "Vilanova i la Geltrú", "Viladecans", "Castelldefels", "Prat de Llobregat", "El Prat",
    "Granollers", "Cerdanyola del Vallès", "Mollet del Vallès", "Vic", "Esplugues de Llobregat", "Gavà", "Sant Feliu de Llobregat", "Igualada",
    "Vilafranca del Penedès", "Ripollet", "Sant Adrià de Besòs", "Montcada i Reixac", "Sant Joan Despí", "Barberà del Vallès", "Sant Pere de Ribes", "Sitges",
    "Martorell", "Premià de Mar", "Pineda de Mar", "Sant Vicenç dels Horts", "Sant Andreu de la Barca", "Molins de Rei", "Santa Perpètua de Mogoda",
    "Castellar del Vallès", "Olesa de Montserrat", "Masnou", "Esparreguera", "Manlleu", "Vilassar de Mar", "Calella", "Malgrat de Mar", "Sant Quirze del Vallès",
    "Parets del Vallès", "Berga", "Les Franqueses del Vallès", "Caldes de Montbui", "Sant Celoni", "Cardedeu", "Canovelles", "Sant Just Desvern",
    "Montornès del Vallès", "La Garriga", "Girona", "Figueres", "Blanes", "Lloret de Mar", "Olot", "Salt", "Palafrugell", "Sant Feliu de Guíxols", "Banyoles",
    "Roses", "Palamós", "Santa Coloma de Farners", "Torroella de Montgrí", "Castelló d'Empúries", "La Bisbal d'Empordà", "Lleida", "Tàrrega", "Balaguer",
    "Mollerussa", "La Seu d'Urgell", "Cervera", "Solsona", "Tarragona", "Reus", "Tortosa", "El Vendrell", "Cambrils", "Salou", "Valls", "Calafell", "Amposta",
    "Vilaseca", "Sant Carles de la Ràpita", "La Ràpita", "Torredembarra", "Móra d'Ebre", "Sants", "Les Corts", "Sarrià", "Horta", "Nou Barris", "Sant Andreu",
    "Sant Martí", "Gràcia", "Eixample", "Ciutat Vella",
    "Antigua y Barbuda", "Argentina", "Bahamas", "Barbados", "Belice", "Bolivia", "Brasil", "Canadá", "Chile", "Colombia", "Costa Rica", "Cuba", "Dominica",
    "Ecuador", "El Salvador", "Estados Unidos", "Granada", "Guatemala", "Guyana", "Haití", "Honduras", "Jamaica", "México", "Nicaragua", "Panamá", "Paraguay",
    "Perú", "República Dominicana", "San Cristóbal y Nieves", "San Vicente y las Granadinas", "Santa Lucía", "Surinam", "Trinidad y Tobago", "Uruguay",
    "Venezuela", "Puerto Rico", "Guayana Francesa", "Groenlandia", "Bermudas",
]

# Street types, those that are shortened with or without a dot, and words between a street's type and name.
STREETS = "Calle Carrer Avenida Paseo Passeig Plaza Plaça Camino Camí Via Vía Ronda Travesía Travesia Travessera Passatge Pasaje Carretera".split()
STREETS_SHORT = "Av Avda Ctra".split()
STREET_LINKS = "de la el del dels i y".split()
STREET_SAINTS = "san sant santa".split()

# What a hospital's name begins with, and words that lead on to a capitalised one.
HOSPITALS = ["Hospital", "Clínica", "Complejo Hospitalario", "CAP", "Centre", "Centro de Salud"]
HOSPITAL_LINKS = ["de la", "del", "de", "la", "el", "los", "las", "i", "y", "San", "Sant", "Santa", "Virgen", "Marqués", "Doctor"]

# What a signature begins with.
SIGNED = ["Remitido por", "Emitido por", "Fdo", "Firmado por"]

# Words that announce a name on their line; the last four also announce single words.
SINGLE_KEYWORDS = "nombre nom apellidos cognoms".split()
KEYWORDS = (
    "nombre paciente contacto persona responsable cuidador cuidadora tutor tutora familiar madre padre hijo hija esposa esposo marido mujer hermano hermana "
    "tío tía abuelo abuela nieto nieta sobrino sobrina primo prima cuñado cuñada suegro suegra yerno nuera pareja cónyuge novio novia nom contacte mare pare "
    "fill filla espòs marit dona germà germana oncle tia avi àvia nét néta nebot neboda cosí cosina cunyat cunyada sogre sogra gendre nora parella cònjuge "
    "xicot xicota nòvio nòvia facultatiu profesional responsables apellidos cognoms valoración valoració"
).split()

# Capitalised words that are no names (form fields, wards, eponyms).
NOT_SINGLE = set(
    "localidad provincia historia actual antecedentes personales familiares motivo consulta enfermedad exploración física pruebas complementarias evolución "
    "tratamiento diagnóstico diagnostico curso clínico clínica alergias hábitos habitos tóxicos toxicos interconsultas observaciones plan resumen cuidados "
    "intensivos paliativos neonatales antígeno prostático específico escherichia coli budd chiari ziehl nielsen melanoma priapismo remitido servicio unidad "
    "centro universidad facultad medicina odontología instituto hospital complejo fundación fundació".split()
)

# Medical words that a run of capitals may be without being a name.
MEDICAL = set(
    "urología cardiología digestivo respiratorio neurología traumatología urgencias medicina interna atención primaria mg/dl mmhg bpm lpm sat o2 pcr vsg "
    "hba1c colesterol hdl ldl triglicéridos got gpt ggt fa bilirrubina creatinina urea sodio potasio cloro calcio fósforo magnesio hierro ferritina tsh t4 t3 "
    "vitamina clínic clínico hospital urgències informe hcp trastorno síndrome enfermedad diabetes mellitus insuficiencia renal cardíaca respiratoria aguda "
    "crónica severa leve moderada tratamiento dosis pauta comprimido pastilla jarabe solución inyección vía oral intravenosa intramuscular subcutánea paciente "
    "usuario historia clínica alta ingreso consulta visita diagnóstico evolución plan antecedentes personales familiares quirúrgicos patológicos psiquiátricos "
    "alergias hábitos tóxicos exploración física constantes vitales tensión arterial frecuencia temperatura saturación oxígeno peso talla índice masa corporal "
    "fármaco medicamento principio activo posología abilify adiro aspirina atorvastatina bisoprolol captopril depakine diazepam enalapril fluoxetina furosemida "
    "ibuprofeno insulina lorazepam metformina metamizol nolotil omeprazol paracetamol plavix prednisona quetiapina salbutamol sintrom simvastatina trankimazin "
    "ventolin zolpidem".split()
)

# Headings in capitals that are no names.
HEADINGS = {
    "ANTECEDENTES FAMILIARES", "ANTECEDENTES PERSONALES", "MOTIVO DE CONSULTA", "ENFERMEDAD ACTUAL", "EXPLORACIÓN FÍSICA", "PRUEBAS COMPLEMENTARIAS", "EVOLUCIÓN",
    "TRATAMIENTO", "DIAGNOSTICO", "DIAGNÓSTICO", "CURSO CLINICO", "CURSO CLÍNICO", "ALERGIAS", "HABITOS TOXICOS", "HÁBITOS TÓXICOS", "INTERCONSULTAS",
    "OBSERVACIONES", "PLAN", "RESUMEN", "HISTORIA ACTUAL",
}
