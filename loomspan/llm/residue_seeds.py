"""Seed phrases of the residue models: texts that stand in place of content on the web."""

# Filler, in natural order.
FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Your text here. Your content here. Your title here. Insert your text here. Add your text here. Type your text here.
Add a description here. Description goes here. Write a description for this item here. Content goes here. Title goes here.
Sample text. Sample answer goes here. Example response. Example text. Placeholder text. Dummy text. Dummy copy, do not publish.
This is placeholder text. This is dummy text. This is a sample page. Replace this text with your own content.
This section is under construction. This page is under construction. Coming soon. Content coming soon. Check back later.
To be added. To be completed. To be announced. To be written. Untitled document. New document. Heading one. Heading two. Subheading.
Click here to edit this text. Click to add text. Click to add title. Insert paragraph here. Hello world! This is your first post, edit or delete it. Add your summary in this box. Replace it with your own content. Example response number 1. This is placeholder text. Lorem ipsum. Edit this text. Double click to edit. Text text text text. Blah blah blah blah. Test test test. asdf asdf qwerty.
Texte provisoire, à remplacer plus tard. Votre texte ici. Ajoutez votre texte ici. Texte d'exemple. Page en construction. Contenu à venir.
Blindtext. Platzhaltertext. Hier steht später der richtige Inhalt. Hier kommt Ihr Text hin. Ihr Text hier. Diese Seite befindet sich im Aufbau. Inhalt folgt in Kürze.
Texto de ejemplo, pendiente de redacción. Escribe aquí tu texto. Su texto aquí. Texto de relleno. Página en construcción. Contenido próximamente.
"""

# Error pages and messages, in natural order.
ERROR = """
404 Not Found. Error 404. Page not found. HTTP 500: Internal Server Error. 403 Forbidden. 401 Unauthorized. 400 Bad Request. 429 Too Many Requests.
502 Bad Gateway. 503 Service Unavailable. 504 Gateway Timeout. 408 Request Timeout. 410 Gone. Status code: 404. Code 500. Request id: 0a1b2c3d.
The requested page could not be found on this server. The page you requested does not exist. We can't seem to find the page you are looking for.
The page you are looking for may have been moved or deleted. The requested URL was not found on this server. If you typed the address, check the spelling.
Something went wrong. An error has occurred. An unexpected error occurred. We're sorry. Sorry about that. Oops. Please try again later. Try again. Retry. Reload. Go back home.
Something went wrong on our side and our team has been told. The server met an unexpected condition. The server encountered an internal error and was unable to complete your request.
We could not connect to the database. Error establishing a database connection. The upstream service did not answer in time. The site is down for maintenance. The service is temporarily unavailable.
You don't have permission to view this resource. You don't have permission to access this page. Access denied. Your request was blocked by our security rules. Permission denied.
Your session has expired, please log in again. You have reached your limit. Rate limit exceeded. This content is not available in your country. This content is no longer available.
Nothing here. Nothing was found. Maybe try a search? Contact the site owner if this keeps happening. Contact the administrator if the problem persists. Ray ID: 5f6e7d8c. Verify you are human to see the full text. Ray 0a1b2c3d4e. Verify you are human to continue. Verify you are human to access this page. The link you followed may be broken. Generation failed: model endpoint returned status 503. <error><code>502</code><message>Bad Gateway</message><id>0a1b2c</id></error> Checking your browser before you continue. This may take a few seconds. Verify you are human to view this page.
ERR_CONNECTION_TIMED_OUT ERR_CONNECTION_REFUSED ERR_NAME_NOT_RESOLVED DNS_PROBE_FINISHED_NXDOMAIN
Traceback (most recent call last): File "main.py", line 10, in run TimeoutError: no answer after 30 s ValueError KeyError NullPointerException exception in thread main at line
null pointer at 0x00000000 segmentation fault (core dumped) Warning: undefined index 'title' in page.php on line 12 Fatal error: uncaught exception. upstream closed the connection, code 502 [proxy] [error]
{"error": {"code": 404, "message": "Not Found", "request": "0a1b2c3d"}} {"status": "failed", "detail": "Unauthorized", "retry_after": 30} {"status": "error", "message": "Internal Server Error"}
Page introuvable. La page demandée n'existe pas. Le lien que vous avez suivi n'existe plus. Erreur interne du serveur. Veuillez réessayer plus tard. Accès refusé. Vous n'avez pas les droits nécessaires.
Seite nicht gefunden. Die angeforderte Seite existiert nicht mehr. Interner Serverfehler. Versuchen Sie es später noch einmal. Zugriff verweigert. Bitte melden Sie sich erneut an.
Página no encontrada. El enlace que has seguido ya no existe. Error interno del servidor. Vuelve a intentarlo más tarde. Acceso denegado. Inicia sesión de nuevo.
"""

# Notices that scripts or cookies are required, in natural order.
NOTICE = """
Please enable JavaScript to view this page. Please turn on JavaScript in your browser to continue. You need to enable JavaScript to run this app. JavaScript is required. JavaScript is disabled in your browser.
This site requires JavaScript and cookies. This app needs scripts. This page relies on scripting. This site works best with JavaScript; yours seems to be switched off. It looks like JavaScript is turned off in your browser.
Cookies must be allowed before we can show this. Please activate cookies to continue. You need to allow cookies to access this page. We noticed that cookies are blocked. To view this page, switch on JavaScript and cookies first.
To see the full text, allow active content first. Scripting must be allowed in your settings before we can show this. Your browser does not support JavaScript. Your browser is not supported. Noscript: JavaScript needed. Please turn off your ad blocker. This app cannot run without it.
Veuillez activer JavaScript pour afficher cette page. JavaScript est désactivé dans votre navigateur, cette page ne peut pas s'afficher. Ce site nécessite JavaScript pour fonctionner. Veuillez accepter les cookies. Votre navigateur ne prend pas en charge JavaScript.
Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen. JavaScript ist in Ihrem Browser deaktiviert. Diese Seite benötigt JavaScript. Bitte erlauben Sie Cookies. Ihr Browser unterstützt kein JavaScript. Ohne JavaScript kann die Seite nicht geladen werden.
Active JavaScript en su navegador para ver esta página. JavaScript está desactivado en su navegador. Este sitio necesita JavaScript para mostrar esta página. Debe habilitar las cookies. Su navegador no admite JavaScript. Sin JavaScript no se puede cargar la página.
"""

# Plain prose of some languages, also about the things above, so that a small corpus isn't all that counts as natural.
NATURAL = """
The road along the river was closed for three days, because the water had come over the fields after the heavy rain.
My sister asked whether we could meet in the old market hall, but nobody knew when it would be open again.
The placeholder in the first column stands for the name of the customer, and our examples show how it is filled.
When a page is missing, the server returns a status and the program writes a line to its log; most users never see it.
If scripts are disabled in the browser, the form still works, although the preview of the letter is not shown.
They explained that the template of the report had been changed last year and that an error in it went unnoticed.
La route le long de la rivière est restée fermée pendant trois jours, parce que l'eau avait couvert les champs.
Quand une page manque, le serveur renvoie un code et le programme écrit une ligne dans son journal.
Die Straße am Fluss war drei Tage lang gesperrt, weil das Wasser nach dem Regen über die Felder gekommen war.
Wenn eine Seite fehlt, meldet der Server einen Fehler, und das Programm schreibt eine Zeile in sein Protokoll.
La carretera junto al río estuvo cerrada tres días, porque el agua había cubierto los campos después de la lluvia.
Cuando falta una página, el servidor devuelve un código y el programa escribe una línea en su registro.
"""

# Forms of open slots.
SLOT = (
    r"\{\{[^{}\n]{1,60}\}\}|\$\{[^{}\n]{1,60}\}|<%[^%\n]{1,60}%>|\[\[[^\[\]\n]{1,60}\]\]|\{(?:\d{1,2}|[a-z][a-z_]{1,30})\}|%[A-Z][A-Z_]{2,30}%|__[A-Z][A-Z_]{2,30}__"
    r"|\[(?:[A-Z][A-Z_ ]{2,30}|(?i:insert|add|your|enter) [^\]\n]{1,40})\]|<(?i:insert|add|your|enter)[ _][^<>\n]{1,40}>|\bXX/XX/XX(?:XX)?\b|\bTODO: ?(?:add|write|insert|fill)|\bTBD(?: TBD)+\b|(?<![\w%])%[sd](?!\w)|\bXXXX+\b|\[\.\.\.insert\]"
)

# Words near a slot that is only spoken of.
SPOKEN_OF = r"(?i)\b(?:placeholders?|slots?|templates?|variables?|stands? for|called|named|syntax|formatter|escaped?|platzhalter|steht für|heißt|marcador(?:es)?|se llama|representa|espace réservé|s'appelle|signifie)\b"

# Slots, two blanks between them, from whose shapes the slot model learns.
SLOTS = """
{{ name }}  {{name}}  {{customer_name}}  {{ user.first_name }}  {{ city }}  {{#if x}}  {{date}}  {{ 0 }}  {{TITLE}}  {{ OrderId }}
${name}  ${ name }  ${user_name}  ${user.name}  ${VALUE}  ${0}  <%= name %>  <% name %>  <%= user.name %>
[[name]]  [[ name ]]  [[Name]]  [[NAME]]  [[topic here]]  {name}  {first_name}  {topic}  {0}  {1}  {00}
%NAME%  %FIRST_NAME%  %USER%  __NAME__  __FIRST_NAME__  __TITLE__  [NAME]  [YOUR NAME]  [FIRST_NAME]  [COMPANY]  [CITY]
[insert name]  [Insert name here]  [your name]  [Your Name]  [Your Company Name]  [add text]  [enter date]  [INSERT NAME HERE]  [...insert]
<insert name>  <INSERT_NAME>  <Insert name here>  <your name>  <YOUR_NAME>  <add text>  <enter_date>
XX/XX/XX  XX/XX/XXXX  XXXX  XXXXX  XXXXXXXX  TODO: add  TODO: write  TODO: insert  TODO: fill  TBD TBD  TBD TBD TBD  %s  %d  (%s)  %s,  %d.
"""
