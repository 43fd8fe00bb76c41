"""Built-in ordinary sentences of each language."""

from __future__ import annotations

# Plain sentences, so that a language without labelled rows has a model too, and so that residue has something to differ from.
SENTENCES = {
    "en": "The weather was good and we went for a walk in the park with our friends. I think that this is not what they wanted, but it works. Has anyone seen where my keys are? You should have told me before the meeting. There is something about the house which makes it feel older than it is. She would like to know how much time we need for the next one. He said it took only a few minutes to get there from the station. What do you think about that? Thanks for your help, it was really useful. Every year people come here because of the small market. If you want to learn more, just look at these pictures. Can you open the window when you leave? We were never able to find out who did it. Those are not the same ones as yesterday. Nothing is better than a quiet evening at home with a good book. They will come back soon because their mother is waiting.",
    "de": "Das Wetter war gut und wir sind mit unseren Freunden im Park spazieren gegangen. Ich glaube, dass sie das nicht wollten, aber es geht auch so. Hat jemand gesehen, wo meine Schlüssel sind? Du hättest mir das vor dem Treffen sagen sollen. Es gibt etwas an diesem Haus, das älter wirkt, als es ist. Sie möchte wissen, wie viel Zeit wir für das nächste Mal brauchen. Er sagte, es dauert nur wenige Minuten vom Bahnhof bis hierher. Was denkst du darüber? Danke für eure Hilfe, das war wirklich nützlich. Jedes Jahr kommen viele Leute wegen des kleinen Marktes. Wenn ihr mehr lernen wollt, schaut euch einfach diese Bilder an. Kannst du das Fenster öffnen, wenn du gehst? Wir konnten nie herausfinden, wer es war. Das sind nicht dieselben wie gestern. Nichts ist besser als ein ruhiger Abend zu Hause mit einem guten Buch. Sie werden bald zurückkommen, weil ihre Mutter wartet.",
    "fr": "Il faisait beau et nous sommes allés nous promener dans le parc avec nos amis. Je pense que ce n'est pas ce qu'ils voulaient, mais cela marche. Est-ce que quelqu'un a vu où sont mes clés ? Tu aurais dû me le dire avant la réunion. Il y a quelque chose dans cette maison qui la fait paraître plus vieille. Elle voudrait savoir combien de temps il nous faut pour la prochaine fois. Il a dit qu'on met seulement quelques minutes depuis la gare. Qu'en penses-tu ? Merci pour votre aide, c'était vraiment utile. Chaque année, les gens viennent ici à cause du petit marché. Si vous voulez en apprendre plus, regardez ces images. Peux-tu ouvrir la fenêtre quand tu sors ? Nous n'avons jamais su qui l'avait fait. Ce ne sont pas les mêmes qu'hier. Rien ne vaut une soirée tranquille à la maison avec un bon livre. Ils vont bientôt revenir parce que leur mère les attend.",
    "es": "Hacía buen tiempo y fuimos a pasear por el parque con nuestros amigos. Creo que no es lo que querían, pero funciona. ¿Alguien ha visto dónde están mis llaves? Tendrías que habérmelo dicho antes de la reunión. Hay algo en esta casa que la hace parecer más vieja de lo que es. Ella quiere saber cuánto tiempo necesitamos para la próxima vez. Dijo que se tarda solo unos minutos desde la estación. ¿Qué te parece? Gracias por vuestra ayuda, fue muy útil. Cada año la gente viene aquí por el pequeño mercado. Si quieres aprender más, mira estas imágenes y luego escribe lo que has visto. ¿Puedes abrir la ventana cuando salgas? Nunca pudimos averiguar quién lo hizo. Estos no son los mismos que ayer. Nada es mejor que una noche tranquila en casa con un buen libro. Volverán pronto porque su madre los está esperando.",
    "it": "Il tempo era bello e siamo andati a passeggiare nel parco con i nostri amici. Penso che non sia quello che volevano, però funziona. Qualcuno ha visto dove sono le mie chiavi? Avresti dovuto dirmelo prima della riunione. C'è qualcosa in questa casa che la fa sembrare più vecchia di quello che è. Lei vorrebbe sapere quanto tempo ci serve per la prossima volta. Ha detto che ci vogliono solo pochi minuti dalla stazione. Che cosa ne pensi? Grazie per il vostro aiuto, è stato davvero utile. Ogni anno la gente viene qui per il piccolo mercato. Se volete imparare di più, guardate queste immagini e poi scrivete. Puoi aprire la finestra quando esci? Non siamo mai riusciti a sapere chi è stato. Questi non sono gli stessi di ieri. Niente è meglio di una serata tranquilla a casa con un buon libro. Torneranno presto perché la loro madre li sta aspettando.",
    "pt": "O tempo estava bom e fomos passear no parque com os nossos amigos. Acho que não é o que eles queriam, mas funciona. Alguém viu onde estão as minhas chaves? Devias ter-me dito isso antes da reunião. Há alguma coisa nesta casa que a faz parecer mais velha do que é. Ela gostava de saber quanto tempo precisamos para a próxima vez. Ele disse que são só alguns minutos desde a estação. O que você acha disso? Obrigado pela vossa ajuda, foi muito útil. Todos os anos as pessoas vêm aqui por causa do pequeno mercado. Se quiserem aprender mais, vejam estas imagens e depois escrevam. Podes abrir a janela quando saíres? Nunca conseguimos descobrir quem o fez. Estes não são os mesmos de ontem. Nada é melhor do que uma noite calma em casa com um bom livro. Eles vão voltar em breve porque a mãe deles está à espera. Por favor, não se esqueçam de fechar a porta.",
    "nl": "Het weer was goed en we zijn met onze vrienden in het park gaan wandelen. Ik denk dat dit niet is wat ze wilden, maar het werkt wel. Heeft iemand gezien waar mijn sleutels zijn? Je had me dat voor de vergadering moeten zeggen. Er is iets aan dit huis waardoor het ouder lijkt dan het is. Zij wil graag weten hoeveel tijd we nodig hebben voor de volgende keer. Hij zei dat het maar een paar minuten duurt vanaf het station. Wat vind je daarvan? Bedankt voor jullie hulp, het was echt nuttig. Elk jaar komen er mensen vanwege de kleine markt. Als je meer wilt leren, kijk dan naar deze foto's en schrijf ons. Kun je het raam openen als je weggaat? We hebben nooit kunnen achterhalen wie het gedaan heeft. Dit zijn niet dezelfde als gisteren. Niets is beter dan een rustige avond thuis met een goed boek. Ze komen snel terug omdat hun moeder op hen wacht.",
}
