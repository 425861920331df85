"""Messages of common servers, publishing systems and editors' templates, collected after the grammars were written and not used to change them."""

PAGES = [
    "The requested URL was not found on this server.", "You don't have permission to access this resource.", "This site can't be reached. The server took too long to respond.", "Web server is down. Error code 521",
    "Sorry, you have been blocked. You are unable to access this website.", "Please turn JavaScript on and reload the page.", "Please enable cookies and reload the page.", "Verify you are human by completing the action below.",
    "This page isn't working right now.", "There has been a critical error on this website.", "Error establishing a database connection", "Briefly unavailable for scheduled maintenance. Check back in a minute.",
    "Our services aren't available right now. We're working to restore all services as soon as possible.", "The page you were looking for doesn't exist. You may have mistyped the address or the page may have moved.", "We're sorry, but something went wrong.", "HTTP Error 500.19 - Internal Server Error",
    "502 Bad Gateway nginx/1.18.0", "The resource cannot be found.", "Application error: a client-side exception has occurred.", "You need to enable JavaScript to run this app.", "This content is no longer available.", "Your session has timed out. Please log in again.",
    "No se puede acceder a este sitio web.", "Error al establecer una conexión con la base de datos", "No está disponible por mantenimiento programado. Vuelve a comprobar el sitio en unos minutos.", "Ha habido un error crítico en esta web.", "La página que busca no se ha encontrado.", "Necesita activar JavaScript para usar esta aplicación.", "No tiene permiso para ver esta página.", "Contenido no disponible en su región.",
    "Erro ao estabelecer uma conexão com o banco de dados", "Brevemente indisponível para manutenção agendada. Volte em um minuto.", "A página que você procura não foi encontrada.", "Você precisa habilitar o JavaScript para executar este aplicativo.", "Você não tem permissão para acessar esta página.", "Este site está temporariamente fora do ar.",
    "Erreur lors de la connexion à la base de données", "Brièvement indisponible pour cause de maintenance planifiée. Veuillez revenir dans quelques instants.", "La page que vous cherchez n'a pas été trouvée.", "Vous devez activer JavaScript pour utiliser cette application.", "Vous n'avez pas l'autorisation d'accéder à cette page.", "Il y a eu une erreur critique sur ce site.",
]
FILLER = [
    "This is sample text. Replace it with your own.", "Write your text here.", "Add your description here.", "Your content goes here.", "Insert headline here", "Type something here to get started.", "This is a placeholder paragraph.", "Welcome to your first post. Edit or delete it, then start writing!",
    "Escriba aquí su texto.", "Este es un texto de ejemplo.", "Aquí va la descripción del artículo.", "Texto provisional", "Párrafo de prueba para la maquetación.", "Añada aquí el contenido.", "Escreva aqui o seu texto.", "Este é um texto de exemplo.", "Insira o título aqui.", "Parágrafo de teste.",
    "Écrivez votre texte ici.", "Ceci est un texte d'exemple.", "Ajoutez votre description ici.", "Insérez le titre ici.", "Paragraphe de remplissage.", "hola hola hola hola hola hola", "x y x y x y x y x y", "The quick brown fox jumps over the lazy dog.",
]
