"""Sentences labelled by hand to start the classifier of :mod:`toxicity`; the reviewed documents do the rest.

They were written for this list, as such things are said anywhere; none is taken from a table that the classifier is
measured on."""

OFFENSIVE = """
what an idiot you are, go back to school
you are too stupid to tie your own shoes
shut your mouth, you filthy liar
you ugly pig, look at yourself
get lost, loser, everyone hates you
he is a complete moron and so are his fans
you disgusting piece of trash
nobody wants you here, you worthless clown
only an imbecile could write such rubbish
that bastard deserves to be beaten
go hang yourself, you freak
kill yourself, the world is better without you
i am going to find you and cut your throat
watch your back, we know your address and your family
you will pay for this, i will smash your face
he should be shot like a dog
somebody ought to burn down their house
all immigrants are rats and parasites
that race is filth, vermin, less than human
gas them all, they are a disease on our country
those people are animals, keep them away from our children
women like her are only good for one thing, the stupid whore
deport every one of them, they are scum
their kind multiply like insects
retards should not be allowed outside
sexy girls waiting for you tonight, naked live show, join now
free xxx videos, hot nude teens, hardcore sex
she moaned as he pushed her onto the bed and kissed her naked breasts
call me baby, i am so horny and wet for you
he pulled down her panties and licked her until she came
eres un idiota y un inútil
cállate ya, imbécil, no sirves para nada
vete a la mierda, cerdo asqueroso
maldito desgraciado, das vergüenza
ojalá te mueras, perro
te voy a matar, sé tu dirección
te voy a partir la cara cuando te vea
esos inmigrantes son ratas, que se vayan todos
esa raza es una plaga, hay que exterminarlos
son animales y no merecen vivir
chicas desnudas esta noche, sexo en vivo, entra gratis
estoy caliente y desnuda, ven a mi cama
videos porno gratis sin censura
you stupid idiot, shut up
shut up, you ugly loser
you filthy pig, nobody likes you
what a moron, you disgusting clown
you are worthless trash and everyone knows it
i will kill you and your whole family
i will find you and break your face
we will burn your house down, you filthy rat
those immigrants are vermin and filth
these animals are less than human, gas them
all of them are parasites and scum, deport them
sexy naked girls tonight, horny and wet
hot nude girls, free live sex show, join now
she was naked and wet and moaned as he licked her breasts
eres un imbécil y un cerdo
cállate, idiota asqueroso
te voy a matar, perro desgraciado
esos animales son una plaga, que se mueran
sexo gratis con chicas calientes y desnudas
""".strip().split("\n")

HARMLESS = """
the film tells the story of a pig that saves a farm from rats
he was called an idiot at school and still suffers from it
victims of threats should keep every message and call the police
the word retard was once a clinical term and is now an insult
the judge heard that the man had said i will kill you
i feel stupid for asking, but how often should i take it
i hate the way i look and feel worthless on most days
the painting shows a naked woman on a bed of flowers
sex education lowers the number of infections among the young
breast pain and wet dreams are common at that age and harmless
the drug kills the parasite but spares its host
cockroaches, rats and other vermin carry the plague
a racist chant was heard and the club was fined
people with suicidal thoughts should be asked whether they have a plan
erectile dysfunction can be the first sign of a heart disease
porn addiction was discussed in a report on young adults
la película trata de un cerdo y una rata que son amigos
le llamaban idiota en el colegio y aún lo recuerda
la plaga de ratas y cucarachas se trató con veneno
me siento inútil y fea, no sé qué hacer
el dolor durante el sexo debe consultarse sin vergüenza
denunció que le habían dicho te voy a matar
the train was late and nobody told us why
my daughter was given new tablets last week
thank you all for your help, it got better
the results came back fine and i was sent home
patients over sixty should have a blood test twice a year
the report found no link between the two
el tren llegó tarde y nadie avisó
gracias a todos, ya estoy mejor
los resultados salieron bien y me mandaron a casa
the doctor asked whether anyone at home had threatened her
he was told that nobody likes him and stopped going to school
the vermin was removed from the kitchen before the inspection
i feel like a worthless idiot when i forget my tablets
the girls in the study had their first sexual contact at sixteen
the naked eye cannot see these worms
what should i do if the wound is still wet in the morning
the report says that staff were called filthy names by visitors
does anyone know whether this pain will go away
the house was burnt down and the family found a new home
men with this disease may find sex painful
people who breed rats for research should be vaccinated
la enfermera preguntó si alguien la había amenazado en casa
el estudio trata del sexo en la adolescencia
me siento como un imbécil cuando olvido las pastillas
qué debo hacer si la herida sigue igual por la mañana
""".strip().split("\n")
