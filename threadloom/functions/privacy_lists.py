"""What the privacy categories are made of: hosts, names and phrases on folded text (lower case, no accents).

Fixed values, all of them: results depend on these very words. ``{a|b}`` stands
for each choice, ``#`` for a digit, ``~`` for a word that ends in s.
"""

BANK_DOMAINS = (
    # banks and cards
    "chase.com jpmorgan.com jpmorganchase.com bankofamerica.com bofa.com ml.com merrilledge.com wellsfargo.com wf.com capitalone.com citi.com citibank.com citicards.com americanexpress.com aexp.com discover.com discovercard.com "
    "usbank.com pnc.com tdbank.com td.com truist.com regions.com citizensbank.com huntington.com keybank.com fifththird.com navyfederal.org usaa.com synchrony.com synchronybank.com barclaycardus.com barclays.com "
    "marcus.com goldmansachs.com bmoharris.com bmo.com firstrepublic.com svb.com "
    # brokers and coins
    "schwab.com fidelity.com fmr.com vanguard.com robinhood.com etrade.com morganstanley.com wealthfront.com betterment.com acorns.com stash.com webull.com interactivebrokers.com ibkr.com public.com coinbase.com kraken.com "
    # apps for money
    "sofi.com sofi.org ally.com chime.com chimebank.com varo.com current.com venmo.com cash.app zellepay.com wise.com revolut.com n26.com "
    # lenders and credit
    "rocketmortgage.com quickenloans.com mrcooper.com loandepot.com lendingclub.com upstart.com prosper.com affirm.com klarna.com afterpay.com navient.com nelnet.com mohela.com aidvantage.com experian.com equifax.com transunion.com "
    "creditkarma.com myfico.com creditone.com creditonebank.com "
    # Latin America and Spain
    "bbva.com bbva.mx bbva.es bbvanet.com.mx santander.com santander.com.mx santander.es banorte.com banamex.com citibanamex.com bancolombia.com bancolombia.com.co itau.com itau.com.br itau.cl nubank.com.br nu.com.mx nu.com.co "
    "scotiabank.com scotiabank.com.mx hsbc.com hsbc.com.mx bancoazteca.com.mx inbursa.com banregio.com bancoppel.com viabcp.com interbank.pe bancoestado.cl bancochile.cl bancodebogota.com davivienda.com banreservas.com popular.com "
    "bancopopular.com bancomer.com caixabank.es bankinter.com sabadell.com ing.es bancoprovincia.com.ar galicia.ar bancogalicia.com.ar macro.com.ar bradesco.com.br bb.com.br caixa.gov.br mercantilbanco.com banesco.com"
).split()
BANK_HOST_WORDS = "bank banco banca creditunion federalcu".split()
BANK_NAMES = [
    "bank of america", "bofa", "wells fargo", "capital one", "citibank", "citicards", "american express", "amex", "us bank", "u{|.}s{|.} bank", "u s bank", "charles schwab", "schwab", "robinhood", "e{|*}{| }trade", "navy federal", "usaa",
    "synchrony", "marcus by goldman", "bbva", "bancomer", "santander", "banorte", "banamex", "citibanamex", "bancolombia", "itau", "nubank", "scotiabank", "hsbc", "banco azteca", "bancoppel", "inbursa", "banregio", "davivienda",
    "banreservas", "bradesco", "bankinter", "caixabank", "sabadell", "coinbase", "credit karma", "experian", "equifax", "transunion", "venmo", "cash app", "zelle",
]
#: Brands that are also names or words: they count alone or before one of the endings.
BANK_BRANDS = "chase citi discover ally chime fidelity vanguard pnc sofi td nu current affirm klarna wise marcus truist regions".split()
BANK_ENDINGS = "bank|banco|banca|card|cards|credit|credit card|alert|alerts|alertas|notificaciones|mexico|mx|usa|us|online|mobile|app|investments|financial|securities|brokerage|servicios".split("|")
BANK_TEXT = [
    "account ending{| in}", "card ending{| in}", "acct ending", "ending in ####", "available balance", "your balance", "current balance", "direct deposit", "deposit of $", "zelle {payment|transfer}", "overdraft",
    "statement is {ready|available}", "minimum payment", "credit limit", "fraud alert", "suspicious {activity|transaction}", "transaction {alert|of $}", "purchase of $", "debit card", "credit card {payment|statement}",
    "cuenta terminada en", "tarjeta terminada en", "terminacion ####", "saldo disponible", "tu saldo", "su saldo", "deposito {de|por} $", "transferencia {spei|recibida|enviada}", "spei", "retiro {de|por}", "cargo {de|por} $",
    "compra {de|por} $", "estado de cuenta", "pago minimo", "fecha limite de pago", "limite de credito", "alerta de fraude", "movimiento {en|de} tu {cuenta|tarjeta}",
]

HEALTH_DOMAINS = (
    "mychart.com mychart.org mychartcentral.com epic.com kp.org kaiserpermanente.org cvs.com cvshealth.com caremark.com walgreens.com riteaid.com zocdoc.com onemedical.com labcorp.com questdiagnostics.com goodrx.com "
    "express-scripts.com expressscripts.com optum.com optumrx.com anthem.com aetna.com cigna.com uhc.com myuhc.com unitedhealthcare.com bcbs.com bluecrossma.com bluecross.com bluecrossnc.com floridablue.com humana.com teladoc.com "
    "mdlive.com amwell.com healow.com followmyhealth.com athenahealth.com patientportal.com nextmd.com solv.com hims.com hers.com ro.co talkspace.com betterhelp.com oscarhealth.com hioscar.com ambetter.com medicare.gov healthcare.gov "
    "imss.gob.mx issste.gob.mx farmaciasguadalajara.com fahorro.com farmaciasdelahorro.com.mx benavides.com.mx farmaciasanpablo.com.mx sanitas.es sanitas.com doctoralia.com doctoralia.com.mx doctolib.fr salud.gob.mx gnp.com.mx"
).split()
HEALTH_HOST_WORDS = "dental dentist dentista clinic clinica medical medico hospital pharmacy farmacia orthodont dermatolog pediatr urgentcare radiolog optometr chiropract physicaltherapy fisioterapia laboratorio".split()
HEALTH_NAMES = [
    "mychart", "kaiser permanente", "cvs pharmacy", "walgreens", "rite aid", "zocdoc", "one medical", "labcorp", "quest diagnostics", "goodrx", "express scripts", "optumrx", "teladoc", "farmacia", "farmacias", "pharmacy", "dental",
    "dentista", "dentist", "clinica", "clinic", "hospital", "laboratorio", "consultorio",
]
HEALTH_TEXT = [
    "lab results", "test results {are|is} {ready|available|in}", "your {|test }results are ready", "your prescription", "prescription {|is }ready", "ready for pick{| }up at {|the }pharmacy", "refill {request|reminder|is ready}",
    "patient portal", "appointment {with|at} {dr|doctor}", "dr{|.} ~ office", "explanation of benefits", "medical records", "health insurance claim", "copay", "your doctor", "telehealth visit", "cita medica",
    "cita {con|en} {el|la} {dr|dra|doctor|doctora|dentista|clinica|consultorio}", "cita dental", "resultados de {laboratorio|tus analisis|sus analisis|estudios}", "receta medica", "{tu|su} receta {|esta }lista", "consulta medica",
    "historia clinica", "expediente {clinico|medico}", "orden medica", "seguro de gastos medicos", "reclamo de seguro medico", "tu medico", "su medico",
]
HEALTH_EVENTS = [
    "dentist", "dental", "doctor{|'}{|s} {appointment|visit}", "physical therapy", "physiotherapy", "therapy session", "therapist", "psychiatrist", "psychologist", "dermatologist", "pediatrician", "ob{| }gyn", "gynecologist",
    "colonoscopy", "mammogram", "mri", "x-ray", "blood{| }work", "blood test", "vaccine", "vaccination", "flu shot", "annual physical", "medical checkup", "cita medica", "dentista", "medico", "doctor", "doctora", "terapia", "psicologo",
    "psicologa", "psiquiatra", "dermatologo", "pediatra", "ginecologo", "ginecologa", "analisis de sangre", "vacuna", "chequeo medico",
]

PASSWORD_DOMAINS = "1password.com lastpass.com bitwarden.com dashlane.com keepersecurity.com nordpass.com roboform.com authy.com duosecurity.com".split()
PASSWORD_NAMES = ["1password", "lastpass", "bitwarden", "dashlane", "keeper security", "nordpass", "authy"]
PASSWORD_TEXT = [
    "{verification|security|one-time|one time|login|log-in|log in|sign-in|sign in|authentication|2fa|otp|mfa|auth} {code|pin|passcode}", "your {code|pin|passcode|otp} is", "g-######", "password reset", "reset your password",
    "forgot your password", "change your password", "new password", "temporary password", "two{-| }factor", "2-step verification", "two-step verification", "magic link", "sign{-| }in link", "login link",
    "codigo de {verificacion|seguridad|acceso|confirmacion|inicio de sesion|autenticacion|un solo uso}", "{tu|su} codigo {es|de}", "clave {dinamica|temporal|de acceso|de seguridad|token}", "contrasena temporal",
    "{restablecer|restablece|cambiar|cambia|recuperar|recupera} {|tu |su |la }contrasena", "olvidaste {|tu }contrasena", "verificacion en {dos|2} pasos",
]
#: A value behind one of these and a colon or an equals sign; behind the other word it is no password.
PASSWORD_LABELS, NO_PASSWORD = ["password", "contrasena", "clave", "pwd"], "palabra "

RELATIVES = (
    "mom mommy mother mum mama mami madre dad daddy father papa papi padre grandma grandpa granny nana abuela abuelo abuelita abuelito wife husband hubby wifey esposa esposo marido sister brother sis bro hermana hermano hermanita "
    "hermanito aunt auntie uncle tia tio cousin prima primo son daughter hijo hija suegra suegro cunado cunada nieta nieto sobrina sobrino babe bebe amor honey"
).split() + ["mother in law", "father in law", "mi amor", "my love"]
#: Relatives that a name may follow.
RELATIVES_NAMED = "mom mama mami dad papa papi grandma grandpa abuela abuelo abuelita abuelito aunt auntie uncle tia tio suegra suegro cunado cunada hermana hermano sobrina sobrino".split()
FAMILY_CHATS = ["family", "familia", "fam", "primos", "cousins", "hermanos", "siblings"]
FAMILY_EVENTS = ["mom", "dad", "mama", "papa", "abuela", "abuelo", "grandma", "grandpa", "family dinner", "cena familiar", "reunion familiar"]
NO_FAMILY = ["family office", "family business", "family offices", "oficina familiar", "empresa familiar"]
