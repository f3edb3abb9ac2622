"""Hand-labelled sentences from which the weights of the personal-data model are fitted. {kind:span} marks a segment."""

SEEDS = (
    "Please write to {email:anna.fielding@mail.lake.test} about it.",
    "Her mail (<{email:pokafor12 [at] harbour [dot] example}>) bounced.",
    "Ask {email:tom+list(at)post.hill.invalid} for the key.",
    "Reach me via {email:MARTA.OKAFOR@HILL.EXAMPLE} today.",
    "Bitte an {email:lena-brandauer＠see.example} schreiben.",
    "Escribe a {email:sofia AT mail DOT rio DOT test} por favor.",
    "他的邮箱是 {email:paul_17@lake.example} 。",
    "We met at lake.house yesterday and had tea at noon.",
    "She waited at corner.cafe for an hour.",
    "Find it under @Lakehouse_31 in the app.",
    "Text me: {phone:(212) 555-0190}. It is late.",
    "Text me: {phone:07700 900123}.",
    "He said {phone:+1-415-555-0121}. The lamp is blue.",
    "Call back {name:Anna Fielding} at {phone:617.555.0133} after six.",
    "Call back {name:Tom B. Harrow-Smith} at {phone:6175550133} after six.",
    "Our coach said {phone:+44 7700 900 456}.",
    "Reach me on {phone:1 312 555-0155} or via {email:ingrid@lake.test}.",
    "Erreichbar bin ich per {phone:030 23125 777} oder {email:o.brandauer@see.example}.",
    "Bitte {name:Lena Brandauer} unter {phone:0049 30 23125 111} zurückrufen.",
    "Der Klempner sagt {phone:+49 (0)30 23125-222}.",
    "Man erreicht sie per {phone:030/23125-333}.",
    "On me joint au {phone:06 39 98 12 34} ou par {email:julie@lac.example}.",
    "L'infirmière dit {phone:06.39.98.56.78}.",
    "On me joint au {phone:+33 (0)6 39 98 11 22}.",
    "Devuelve la llamada a {name:Sofía Ibarra} al {phone:555012345}.",
    "Estoy en el {phone:555 01 23 45} o en {email:pedro@rio.test}.",
    "Mi casero dice {phone:+34 555 010 222}.",
    "Llama al {phone:666 12 34 56} por la tarde.",
    "六点以后回电给{name:林思源}，号码 {phone:12012345678} 。",
    "可以打 {phone:+86 120 1234 5678} 或者发到 {email:wu@hu.test} 。",
    "合唱团老师说 {phone:１２０１２３４５６７８} 。",
    "他的号码是 {phone:120-1234-5678} 。",
    "{phone:0086-12012345678} 是他的电话。",
    "My passport number is {id_number:666123456}, do not lose it.",
    "My passport number is {id_number:ZX1234567}, do not lose it.",
    "The form still shows SSN {id_number:666-12-3456}.",
    "For the tax office I am {id_number:QQ 12 34 56 Z}.",
    "For the tax office I am {id_number:666 12 3456}.",
    "The nurse noted {id_number:666-98-7654} on a pad.",
    "Our coach noted {id_number:666987654} on the wall.",
    "My landlord noted {id_number:QQ 98 76 54 Z} on a box.",
    "Meine Ausweisnummer ist {id_number:00123456789}.",
    "Im Formular steht die Steuernummer {id_number:00 123 456 789}.",
    "Die Zahnärztin nennt {id_number:00987654321}.",
    "Mon passeport porte le numéro {id_number:00ZZ12345}.",
    "Le dossier indique le numéro de sécu {id_number:0 12 13 99 123 456 78}.",
    "La voisine donne {id_number:012139912345678}.",
    "En el impreso figura el DNI {id_number:00012345A}.",
    "Mi pasaporte es el {id_number:00054321-W}.",
    "La enfermera anotó {id_number:00098765K} en un papel.",
    "表格上的身份证号还是 {id_number:990011198001011234} 。",
    "护照信息里写着 {id_number:990011 19800101 123X} ，别弄丢。",
    "护士记下 {id_number:990011 19800101 1234} 。",
    "护士记下 {id_number:99001119800101123X} 。",
    "Order 4263-0277-309 was shipped by Lake Parcel.",
    "Order 666-12-3456 was shipped on Monday.",
    "Ticket np-91343 is still open, order 12345678A too.",
    "Update 2.246.137 fixed the alarm; the count is 1234567890123456.",
    "Die Bestellung 420 123 456 ist da.",
    "La commande 0612345678 est partie.",
    "El pedido 00012345A salió ayer.",
    "订单12345678901已寄出。",
    "Her new address is {address:219 Lake Avenue}, third floor.",
    "Deliver it to {address:12B N. Lake St.} before noon.",
    "{name:Marta Okafor} lives at {address:8 Old Harbour Road} now.",
    "The chair goes to {address:5 Lake Row}.",
    "He carried it up 88 steps down the hill, then along the road.",
    "We walked 3 miles that way and 12 minutes down the street.",
    "Das Paket geht an {address:Seestraße 88}.",
    "{name:Oskar Brandauer} wohnt jetzt in der Nähe, {address:Alte Seeallee 14a}.",
    "Die Kollegin wohnt {address:Am Seeplatz 3}.",
    "Auf dem Weg 12 Leute getroffen.",
    "Livrez au {address:14 bis, rue de Lac} avant midi.",
    "Sa nouvelle adresse est {address:47, avenue Rivage}, troisième étage.",
    "{name:Julie Lefèvre} habite maintenant {address:216 bd Colline}.",
    "Il a fait 3 place nette et 2 route longue.",
    "Su nueva dirección es {address:Paseo Lago 170}, tercer piso.",
    "Entrégalo en {address:Calle de Lago, 149} antes de mediodía.",
    "{name:Pedro Solano} vive ahora en {address:C/ Lago 22}.",
    "新地址是{address:湖山路150号}，三楼。",
    "中午前送到{address:山湖街7号}。",
    "联系人{name:林志远}现在住在{address:湖云大道33号}。",
    "邻居小雨搬去{address:云山湖巷12号}了。",
    "她搬去{address:云山湖路5号}了。",
    "用户：新地址是{address:云湖巷77号}，三楼。",
    "My best friend {name:Anna Fielding} moved in.",
    "The contract was signed by {name:Tom Okafor}.",
    "The landlord, {name:Ingrid K. Harrow-Smith}, wants the deposit back.",
    "Dr. {name:Paul Fielding} prescribed a new inhaler.",
    "{name:Marta Fielding} painted a chair while Anna slept.",
    "Borrowed a radio from {name:TOM OKAFOR}.",
    "On the way home {name:Anna B. Okafor} sold the lamp.",
    "{name:FIELDING, Anna} lives here.",
    "{name:Okafor, Marta} lives here.",
    "He bought it from Anna Books at the market.",
    "Yesterday Anna Monday was sad and Tom April too.",
    "My sister Marta bought a lamp from Lake Books, then Tom Sundays came.",
    "AFTER LUNCH ANNA SOLD THE LAMP AND TOM PAINTED IT.",
    "Mina Harbour station is closed; see Lake Hall.",
    "Frau Dr. {name:Ingrid Brandauer} hat angerufen.",
    "Den Vertrag hat {name:Oskar Brandauer} unterschrieben.",
    "Gestern hat Lena Tulpen gekauft und Oskar Brot.",
    "Le docteur {name:Karim Marchand} a prescrit un traitement.",
    "Le contrat est signé par {name:Julie Lefèvre}.",
    "El contrato lo firmó {name:Pedro Ibarra}.",
    "La doctora {name:Sofía R. Solano} recetó otro inhalador.",
    "borrowed a lamp from {name:anna fielding}.",
    "anna sold the lamp and tom painted it.",
    "合同是{name:林小雨}签的。",
    "医生{name:吴志远}开了新药。",
    "昨天下午小雨买了灯，邻居志远也来了。",
    "他和思源分享了灯，因为小雨提过。",
    "昨天{name:吴小雨}卖掉了灯。",
    "一个月前{name:林思源}在湖边藏起了灯。",
    "姐姐小雨向志远借了灯，后来又送给思源。",
    "周五晚上思源买了灯，早饭以后志远修好了它。",
    "房东先卖掉了灯，后来又向小雨借了雨伞。",
    "房东向志远借了灯。房东和思源分享了雨伞。",
    "合唱团老师先买了灯，后来又向思源借了雨伞。",
    "她的医生为小雨开了药，因为志远提过这件事。",
)
