"""Common words of some languages."""

# Frequent function words by language, in natural order.
COMMON = {
    "en": "the a an of to in and that this these those is was are were be been being not no it its for with as by on at from or but will would can could may might should shall must did do does has have had if then than so because before after during until while although though since whereas every another our my your their his her they them he she we us you i me which who whom what why when where how there here all any both each more most some such only own same other first next last many much even into near over under about against between through without within out up down again once also very too just ever still yet however",
    "fr": "le la les l un une des du de d et en est sont était être à au aux ce cet cette ces que qu qui quoi dont où ne n pas plus par pour sur sous dans avec sans il elle ils elles on nous vous je tu me te se s son sa ses leur leurs mon ma mes notre votre mais ou si alors car parce comme très chaque avant après depuis pendant tandis lorsque quand entre vers chez jusqu jusque selon malgré grâce tout toute tous toutes même aussi bien a ont avez avons ai va peut doit fait faut dit",
    "de": "der die das den dem des ein eine einer einem einen eines und oder aber doch denn ist sind war waren sein nicht kein keine im in am an auf aus bei mit nach von vom vor zu zum zur über unter für durch ohne um bis seit trotz dank laut während wegen als wie wenn dann dass ob weil sondern auch nur noch schon sehr mehr so man er sie es wir ihr ich du uns mich dich sich mein dein unser jeder jede jedes jedem alle aller allen diese dieser dieses hat haben hatte wird werden kann muss soll wer was wo warum wann hier dort",
    "es": "el la los las lo un una unos unas de del al a y e o u en es son era ser está están que qué quien cual no ni más menos por para con sin sobre entre hasta desde durante según tras ante bajo cerca fuera pero sino aunque porque pues como cuando donde si entonces mientras cada todo toda todos todas mismo muy también ya se su sus mi mis tu nuestro nos le les me te yo él ella ellos nosotros este esta estos estas ese esa ha han he va puede debe hay fue mucho mucha antes después gracias pesar",
    "it": "il lo la i gli le un una uno di del della dei delle e o in è sono era non che chi per con su da dal dalla al alla nel nella si ma se come anche più questo questa ogni dopo prima quando mentre perché",
    "pt": "o a os as um uma de do da dos das e ou em no na nos nas é são era não que quem por para com sem sobre se mas como também mais este esta cada depois antes quando enquanto porque ao à",
    "nl": "de het een en of in is zijn was niet dat die dit deze van voor met op aan bij uit naar om te door over maar als dan ook nog wel hij zij wij ik je er hun haar elke na tot omdat terwijl",
}
ANY = frozenset(w for x in COMMON.values() for w in x.split())
BY_LANGUAGE = {k: frozenset(v.split()) for k, v in COMMON.items()}
