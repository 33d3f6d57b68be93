"""Texts from which the models of filler, error and script notices are fitted."""

# Error messages as servers and site builders show them.
ERROR_TEXTS = """
Page not found. The page you requested could not be found on this server. The address does not exist or has been moved.
Error 404. The requested document was not found. It may have been removed, renamed or is temporarily unavailable.
404 Not Found. 403 Forbidden. 410 Gone. 500 Internal Server Error. 502 Bad Gateway. 503 Service Unavailable. 504 Gateway Timeout.
Something went wrong. An unexpected error occurred while processing your request. Please try again later.
We are sorry, what you were looking for does not seem to exist. Check the address for typing mistakes or use the search box.
Access denied. You do not have permission to view this page. Your session has expired.
The service is temporarily unavailable. We are down for maintenance and will be back soon.
The server did not answer in time. The upstream service timed out. Request failed with status code. Could not be processed.
Could not connect to the database: too many connections. Fatal error: uncaught exception in file on line.
Warning: undefined index, undefined variable, null reference. The template engine failed to render this view. Stack trace.
This document is no longer here, is gone for good, has been deleted or taken down.

Error. Warning. Failure. Notice. Not available. Nothing here. Request failed. Internal error. Reference code. Trace id. Incident.
That link is broken. Too many requests, you have been rate limited. Sorry, an error has occurred. Problem loading page.
Seite nicht gefunden. Die gewünschte Adresse gibt es hier nicht mehr. Ein Fehler ist aufgetreten. Bitte versuchen Sie es später erneut. Zugriff verweigert.
Page introuvable. L’adresse demandée n’existe pas ou a été déplacée. Une erreur est survenue. Veuillez réessayer plus tard. Accès refusé.
Página no encontrada. La dirección solicitada no existe en este servidor. Esta dirección no existe o fue retirada. Se ha producido un error. Inténtelo de nuevo más tarde. Acceso denegado.
Página não encontrada. O endereço pedido não existe neste servidor. Ocorreu um erro. Tente novamente mais tarde. Acesso negado.
""".strip().splitlines()

# Notices of pages that wait for scripts, and loading signs.
SCRIPT_TEXTS = """
Enable JavaScript in your browser settings to view this page. This site needs JavaScript to work. Scripts are blocked or switched off. Please enable JS first, or pages stay empty. JS is needed to read this site. Without scripting this application cannot start. JavaScript is turned off; please turn it on.
Your browser has scripting disabled. Please allow scripts for this site, then reload the page. Content is being fetched, please wait a moment. Preparing the page. Initializing. Starting up. Just a moment.
Aktivieren Sie JavaScript in Ihrem Browser. Activez JavaScript dans votre navigateur. Habilite JavaScript en el navegador. Ative JavaScript no seu navegador.
Please enable JavaScript to continue.

Please turn on scripts.
Loading...
Wird geladen. Bitte warten.
Chargement en cours. Veuillez patienter.
Cargando. Espere un momento.
Ative o JavaScript no navegador para ver esta página. Carregando. Aguarde um momento.
""".strip().splitlines()

# Filler, dummy and test text.
FILLER_TEXTS = """
Dummy copy fills the box until the real words arrive. Placeholder paragraph, to be replaced with your own story. Put your text here. Blind copy for layout. Write some story or other here, or insert an invented one in this spot. Insert some short story of anything. A short story of yours at a spot like this. Blind text is there to show how the layout and the type look. This blind text shows type only. Sample. Sample headline. Just a sample. Demo. Test. Ignore this text. Headline goes here.
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
asdf asdf qwer qwer hjkl jkl uiop zxcv qwerty foo bar baz qux blah blah test test xyz abc aaa xxx
test test test foo foo bar bar asdf foo qwer test aaa hjkl abc blah xyz jkl
This is sample text. This is placeholder text for the section. Sample page. Demo page. Test page please ignore. New page. Your headline. Untitled section.
Your text goes here. Add your content here.
Dummy text for the layout. Just testing.
Dies ist ein Blindtext. Hier steht ein Beispieltext. Ersetzen Sie diesen Text durch Ihren eigenen.
Ceci est un texte factice. Remplacez ce paragraphe par votre propre texte. Texto de relleno. Sustituya este texto por el suyo. Texto de exemplo. Substitua este texto.
""".strip().splitlines()

# Plain prose of a few languages, so that there is a model of prose whatever the input is.
PROSE_TEXTS = """
The harbour is quiet in the early morning, when the fishermen bring their boats home and sort the catch on the pier. Later the market opens and people from the hills come down to buy bread, cheese and salt.
A good tool keeps its edge for years if it is cleaned after use and stored in a dry place. Most of the work is done by hand, so small differences between two pieces are nothing to worry about.
Each measurement is repeated three times and the mean is written down together with the date. When two values differ by more than a tenth, the instrument is checked before the series goes on.
Der Weg führt zuerst durch den Wald und dann am Ufer entlang, bis hinter der Mühle das Dorf beginnt. Im Sommer sitzen die Leute abends vor den Häusern und erzählen von früher.
Le jardin se trouve derrière la maison, entre le mur de pierre et la rivière. On y cultive des légumes et quelques fleurs, et les enfants y jouent après l’école.
La biblioteca abre por la mañana y guarda libros antiguos que casi nadie pide. El encargado conoce cada estante y encuentra en un momento lo que se busca.
A cidade cresceu devagar ao longo do rio, com ruas estreitas e casas de dois andares. Aos domingos a praça enche-se de gente e ouve-se música até à noite.
""".strip().splitlines()
