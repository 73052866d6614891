"""Lines labelled by hand to train the line classifier of :mod:`boilerplate`.

``{b}`` stands for the name of the site, ``{x}`` for a word that is in no example, ``0`` for a number. English and Spanish.
"""

BOILERPLATE = """
menu
home
news
videos
podcasts
contact
search
sign in
donate
careers
our people
for professionals
drugs a to z
conditions
find a clinic
appointments
pharmacy
tools
help
jobs
press
shop
log in
[news] [tools] [symptoms] [drugs a to z] [for professionals] [careers]
[help] [home] [find a clinic] [drugs a to z] [appointments] [contact]
> home > conditions > videos
> news
> symptoms
> search
> tools
home · videos · symptoms · search · contact
menu / drugs a to z / symptoms / help / pharmacy / for professionals / news
donate videos symptoms news help
donate news our people podcasts contact for professionals appointments conditions
tools > appointments > conditions > find a clinic > our people > pharmacy > home > videos
careers > pharmacy > diagnosis {x} {x} disease
conditions / menu / {x} {x} hepatitis
news / tools / what is {x} {x} nephritis?
conditions » news » {x} {x} encephalitis: symptoms and causes
menu > drugs a to z > {x} mild {x} dermatitis: symptoms and causes
contact / menu / outlook {x} one-sided {x} myopathy
symptoms / help / {x} {x} cardiomyopathy in adults
sign in > drugs a to z > {x} atypical {x} colitis - an overview
our people / news / overview {x} {x} palsy
home » news » living with {x} {x} anaemia
inicio
menú
noticias
vídeos
contacto
ayuda
medicamentos
profesionales
enfermedades
buscar
entrar
donar
empleo
farmacia
citas
buscar centro
> empleo > noticias > contacto
> medicamentos
> contacto
[entrar] [profesionales] [buscar] [donar] [buscar centro] [farmacia] [contacto] [empleo]
vídeos · inicio · contacto · medicamentos · entrar · síntomas · enfermedades
profesionales > menú > contacto > farmacia > noticias > síntomas
entrar » profesionales » causas nefritis de {x} {x}
ayuda / medicamentos / resumen colitis de {x} {x}
empleo » buscar centro » qué es vasculitis de {x}
empleo / buscar centro / miopatía de {x} {x}
profesionales / menú / vivir con hepatitis de {x} {x}
inicio > contacto > ataxia de {x} {x}: síntomas y causas
jump to: prevention, overview - {x} {x} arthritis
on this page: risk factors, complications, tests - {x} {x} ataxia
contents - treatment, self-care, symptoms - {x} {x} fever
in this article: causes, outlook, questions - {x} {x} palsy
en esta página: factores de riesgo, pronóstico, pruebas - dermatitis de {x} {x}
contenido: síntomas, causas, tratamiento - artritis de {x} {x}
we use cookies to make {b} work and to learn how it is used. accept all or manage settings
this site stores small files on your device. by going on you agree to the {b} cookie policy
your privacy matters to {b}: choose which trackers we may set
before you continue to {b}, please review your consent choices
cookies help {b} remember you. ok, got it
{b} and its 0 partners process data to show fitting messages. reject | accept
{b} uses cookies. accept or decline
usamos cookies para que {b} funcione mejor. aceptar o configurar
este sitio guarda archivos en su equipo; al seguir acepta la política de {b}
su privacidad importa a {b}: elija sus preferencias
{b} y sus 0 socios tratan datos para mostrar mensajes. rechazar o aceptar
medically reviewed by the {b} editorial panel on 0 july 0
written and checked by {b} staff writers; last review 0 june 0
by the {b} desk, updated 0 april 0
by the {b} desk, updated 0/0/0
reviewed 0 may 0. next review due 0 months later, {b} board
reviewed 0/0/0. next review due 0 months later, {b} board
fact checked by our nurses at {b}
last updated 0 march 0 by the {b} team
por la redacción de {b}, actualizado el 0 de agosto de 0
por la redacción de {b}, actualizado el 0 de enero de 0
revisado por el comité editorial de {b} el 0 de mayo de 0
texto comprobado por el equipo de {b}
advertisement - continue reading below
article continues below this message
sponsored content: skip to the next section
advertisement
publicidad: siga leyendo más abajo
el artículo continúa debajo del anuncio
publicidad
see also
more on this
most read
related
related articles
popular now
ver también
lo más leído
related: {x} anaemia, {x} complications
related: {x} {x} disorder, {x} causes
read next: {x} dystrophy, {x} when to seek help
read next: {x} disorder, {x} overview
up next: {x} myopathy, {x} treatment
up next: {x} syndrome, {x} risk factors
you may also like {x} dystrophy, {x} symptoms
you may also like {x} syndrome, {x} when to seek help
lea después: {x} miopatía, {x} síntomas
lea después: colitis de {x}, {x}
también le puede interesar {x} ataxia, {x} prevención
también le puede interesar {x} fiebre, {x} factores de riesgo
{x} anaemia guide: {x}
{x} ataxia guide: {x}
{x} hepatitis q&a: {x}
{x} colitis in pictures: {x}
{x} dystrophy quiz: {x}
{x} disease quiz: {x}
{x} síndrome quiz: {x}
{x} neuropatía guide: {x}
{x} miocardiopatía q&a: {x}
{x} parálisis in pictures: {x}
world {x} day: the {x} {x} pledge
from the archive: the {x} {x} appeal
this week only: free {x} talk at {x} hall
visit our {x} {x} fund page
support the {x} appeal
nuevo curso con {x} {x}, plazas abiertas
campaña {x} {x}: done antes del viernes
share this page with a friend: mail, print, copy link
liked it? follow {b} and share the story
tell others about this article on your favourite network
did you find this useful? pass it on | 0 people shared it
send to a colleague - save to my {b} list - print (0)
was this page helpful? yes (0) no (0)
comparta esta página: correo, imprimir, copiar enlace
siga a {b} y comparta el artículo con su familia
¿le fue útil? 0 personas la compartieron
get the weekly {b} letter in your inbox, free of charge
join 0 readers: subscribe to {b} today
sign up for reminders from {b} and never miss a check
download the {b} app and keep your records in one place
take part in our short survey and help improve {b}
subscribe to the {b} newsletter
reciba gratis el boletín semanal de {b} en su correo
únase a 0 lectores de {b}, suscríbase hoy
descargue la aplicación de {b} y guarde sus datos
back to top of the page - report a problem with {b}
call the {b} desk: 0-0
{b} trust, 0 orchard lane, postbox 0
about {b} | accessibility | site map | press | jobs
editorial policy / advertising policy / funding of {b}
volver arriba - informar de un error en {b}
acerca de {b} | accesibilidad | mapa del sitio | prensa
fundación {b}, calle del huerto 0
trademarks belong to {b} or its licensors; reuse needs written leave
(c) 0 {b}. all rights reserved. terms of use and privacy notice apply
nothing on {b} replaces the advice of a clinician. read our disclaimer
{b} is not responsible for the content of outside sites. 0
(c) 0 {b}. todos los derechos reservados. aviso legal y privacidad
{b} no sustituye la consulta con un profesional. lea el descargo
prohibida la reproducción sin permiso de {b}, 0
terms of use | privacy | cookies
""".strip().split("\n")

ARTICLE = """
symptoms
prevention
treatment
when to seek help
living with it
questions
outlook
complications
self-care
overview
tests
causes
risk factors
diagnosis
# symptoms
# causes
# treatment
risk factors:
treatment:
symptoms:
diagnóstico
pruebas
prevención
autocuidado
resumen
tratamiento
causas
pronóstico
síntomas
factores de riesgo
complicaciones
# síntomas
# causas
causas:
pronóstico:
{x} {x} disease
{x} {x} hepatitis in adults
{x} {x} ataxia: symptoms and causes
{x} {x} syndrome - an overview
what is {x} {x} anaemia?
living with {x} {x} vasculitis
{x} slowly growing {x} disorder in adults
{x} mild {x} myopathy: symptoms and causes
{x} {x} arthritis
{x} {x} fever
{x} {x} cardiomyopathy
{x} {x} neuropathy
{x} {x} palsy
living with {x} chronic {x} colitis
living with {x} one-sided {x} fever
living with {x} short-lived {x} syndrome
{x} one-sided {x} dermatitis in adults
{x} severe {x} hepatitis: symptoms and causes
{x} one-sided {x} disorder - an overview
what is {x} early {x} nephritis?
colitis de {x} {x}
nefritis de {x} {x}: síntomas y causas
artritis de {x} {x} en adultos
vivir con hepatitis de {x} {x}
qué es ataxia de {x} {x}
parálisis de {x} {x}
enfermedad de {x} {x}
síndrome de {x} {x}
{x} | 0-0 | mild {x}
{x} | 0-0 | severe {x}
{x} | 0-0 | slowly growing {x}
{x} | 0-0 | crónica {x}
{x} | 0-0 | leve {x}
dose | range | note
{x}, 0 tablets on alternate days
{x}, 0 ml at bedtime
{x}, 0 mg weekly
{x}, 0 drops as needed
{x}, 0 gotas al acostarse
a coagulation screen ({x} method)
blood gas analysis ({x} method)
a urine dipstick ({x} method)
una radiografía de tórax (unidad {x})
las enzimas hepáticas (unidad {x})
la ferritina (unidad {x})
vomiting before breakfast and a rash over the shins, {x} type
cold feet and a hoarse voice, {x} type
cloudy urine after {x}
back pain that wakes the sleeper after {x}
picazón en las palmas tras {x}
0) weakness on one side after {x}
0) itching of the palms after {x}
0) náuseas por la mañana tras {x}
0) una prueba de esfuerzo (unidad {x})
0) {x} con paseos cortos, hasta 0 días
0) {x}, 0 tablets twice a day
0) a metallic taste after {x}
0) an echocardiogram ({x} method)
falta de aire al subir escaleras tras {x}
sabor metálico tras {x}
{x} con una férula nocturna, un mes sí y otro no
{x} con estiramientos diarios, antes de la comida
if you feel unsafe with your symptoms, go to the nearest urgent care point listed by {b}.
call your local emergency line at once if breathing becomes hard or the lips turn blue, says the {b} guide.
do not change your medicine on your own; the {b} handbook explains how to speak with your team first.
everyone is different, and the {b} pages can only describe what happens to most people.
no cambie su medicación por su cuenta; la guía de {b} explica cómo hablar con su equipo.
llame al servicio de urgencias si le cuesta respirar o si los labios se ponen azules, indica la guía de {b}.
cada persona es distinta y las páginas de {b} describen lo que ocurre a la mayoría.
ask your doctor before you stop a medicine, and keep the {b} leaflet at hand.
doctors at the {x} unit order a coagulation screen when a dry cough at night lasts and a missing enzyme is suspected.
ask about thinning hair, cloudy urine and nausea on car journeys before a coagulation screen is arranged.
a 21-year-old came back during a heat wave with night sweats; a skin biopsy showed late damage to the bladder wall.
it is not clear why nurses in our clinic mention a lump under the jaw more than loss of appetite.
in our series, {x} {x} disease begins with slow healing cuts and sudden dizziness, mostly before the next meal.
no link between {x} {x} colitis and an inherited change in one gene has been shown throughout the spring.
with compression stockings, relapse is uncommon, yet night sweats or fever above 0.0 can persist at the end of treatment.
a dose of 0 puffs of {x} before breakfast was enough for confusion in the evening in 0 of 0 cases.
blood gas analysis may be normal at first despite shortness of breath on stairs, given that the aortic root is involved.
{x} should be stopped if numb fingertips or clumsy gait occurs, because the wound may reopen.
changes in the pancreas seen on a patch test point to an overactive immune reply rather than a clot in a small vessel.
many patients first feel palpitations at rest long after the fever has gone, although the outlook is good.
among outpatients, 0 percent had pale stools, 0 percent had numb fingertips, and lung function declines.
if cramps in the calves appears as soon as therapy stops, a patch test and a bone scan help to rule out dehydration.
en la unidad {x} se pide una prueba de esfuerzo cuando persiste fiebre de más de 0 y hay dolor.
tras el alta, la causa de calambres nocturnos parece ser la presión sobre un nervio, y una dieta baja en sal ayuda.
no está claro por qué aparece úlceras en la boca antes que fiebre de más de 0 en colitis de {x} {x}.
una persona de 0 años volvió en primavera con hormigueo en los labios; una prueba mostró daño en la columna lumbar.
en nuestra serie, el 0 por ciento tuvo voz ronca entre 0 y 0 meses y el 0 por ciento dificultad para tragar.
quienes toman {x} deben hacerse una prueba de esfuerzo poco después de la cirugía.
conviene preguntar por desmayo al levantarse, debilidad de un lado y voz ronca antes de pedir una punción lumbar.
con 0 mg de {x} cedió sudoración nocturna en 0 de 0 casos entre 0 y 0 meses.
""".strip().split("\n")

# The same forms for many kinds of illness, so that the kind of illness says nothing about the line.
_EN = "anaemia arthritis ataxia cardiomyopathy carditis colitis dermatitis disease disorder dystrophy encephalitis fever hepatitis myopathy nephritis neuropathy palsy sclerosis syndrome vasculitis".split()
_ES = "anemia artritis ataxia miocardiopatía colitis dermatitis enfermedad distrofia encefalitis fiebre hepatitis miopatía nefritis neuropatía parálisis esclerosis síndrome vasculitis".split()
_LINKS = ["{{x}} {} guide: {{x}}", "{{x}} {} q&a: {{x}}", "{{x}} {} in pictures: {{x}}", "{{x}} {} quiz: {{x}}", "read next: {{x}} {}, {{x}} tests", "menu / home / {{x}} {}"]
_TITLES = ["{{x}} {}: symptoms and causes", "{{x}} {} in adults", "{{x}} {} - an overview", "what is {{x}} {}?", "living with {{x}} {}", "{{x}} {}"]
_ENLACES = ["{{x}} {} guide: {{x}}", "{{x}} {} q&a: {{x}}", "lea después: {{x}} {}, {{x}} causas", "también le puede interesar {{x}} {}, {{x}} resumen", "vídeos / inicio / {} de {{x}} {{x}}"]
_TITULOS = ["{} de {{x}} {{x}}: síntomas y causas", "{} de {{x}} {{x}} en adultos", "vivir con {} de {{x}} {{x}}", "qué es {} de {{x}} {{x}}", "{} de {{x}} {{x}}"]
BOILERPLATE += [_LINKS[(i + k) % 6].format(d) for i, d in enumerate(_EN) for k in (0, 1, 3)] + [_ENLACES[(i + k) % 5].format(d) for i, d in enumerate(_ES) for k in (0, 2)]
ARTICLE += [_TITLES[(i + k) % 6].format(d) for i, d in enumerate(_EN) for k in (0, 1, 3)] + [_TITULOS[(i + k) % 5].format(d) for i, d in enumerate(_ES) for k in (0, 2)]
_MONTHS = "january february march april may june july august september october november december".split()
_MESES = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
_SIGNED = ["medically reviewed by the {{b}} editorial panel on 0 {} 0", "written and checked by {{b}} staff writers; last review 0 {} 0", "by the {{b}} desk, updated 0 {} 0", "reviewed 0 {} 0. next review due 0 months later, {{b}} board"]
_FIRMADO = ["por la redacción de {{b}}, actualizado el 0 de {} de 0", "revisado por el comité editorial de {{b}} el 0 de {} de 0"]
BOILERPLATE += [_SIGNED[(i + k) % 4].format(m) for i, m in enumerate(_MONTHS) for k in (0, 1)] + [f.format(m) for m in _MESES for f in _FIRMADO]
_SIGNS = (
    "shortness of breath on stairs, a dull ache behind the eyes, burning pain below the ribs, pain on deep breathing, stiffness of the hips, a dry cough at night, ringing in the ears, tremor of the hands, "
    "joint swelling in the morning, sudden dizziness, blurred sight in one eye, loss of appetite, heavy legs, yellow eyes, poor sleep, trouble swallowing tablets, bruises without injury, thinning hair, "
    "frequent urination, tingling around the lips, weight loss of several kilos, cramps in the calves, fainting when standing up, flushing of the face, low mood, muscle twitching"
).split(", ")
_SIGNOS = "dolor ardiente bajo las costillas, dificultad para tragar, opresión en el pecho, visión borrosa en un ojo, zumbido en los oídos, rigidez del cuello, moretones sin golpe, desmayo al levantarse, orina turbia, caída del cabello, dedos dormidos, una erupción en las piernas".split(", ")
_CHECKS = "an exercise test, serum ferritin, an eye pressure check, liver enzymes, ultrasound of the abdomen, magnetic resonance imaging, a skin biopsy, a sleep study, spirometry, a hearing test".split(", ")
_EXAMENES = "un estudio del sueño, un hemograma completo, un análisis de orina, una espirometría, una biopsia de piel, una gasometría, una resonancia".split(", ")
ARTICLE += [f"{s} after {{x}}" for s in _SIGNS] + [f"{s} and {t}, {{x}} type" for s, t in zip(_SIGNS[::2], _SIGNS[1::2])] + [f"{s} tras {{x}}" for s in _SIGNOS] + [f"{c} ({{x}} method)" for c in _CHECKS] + [f"{e} (unidad {{x}})" for e in _EXAMENES]
ARTICLE += [f"{{x}} con {a}, {b}" for a, b in zip("terapia del habla, una dieta baja en sal, gotas para los ojos, medias de compresión, hierro por vía oral, menos alcohol, ejercicios de respiración".split(", "), "durante el primer invierno, hacia la tarde, al subir la dosis, en la tercera visita, tras un vuelo largo, en dos días, poco después de la cirugía".split(", "))]
