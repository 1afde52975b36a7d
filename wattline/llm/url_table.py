"""A small labelled url table (invented names): the default training data of the URL filter.

One url per line. A table of one's own is given by path instead (``urlfilter.read_labelled``).
"""

UNWANTED = """
http://lucky-jackpot-slots.example/spin/free
https://www.grand-casino-royal.example/bonus?ref=77
https://play.vegascasino24.example/slots/mega-wheel
http://casino-bonus-codes.example/no-deposit
https://m.online-casinos-top.example/roulette/live
https://poker-win-cash.example/tables/
http://www.winbigpoker.example/signup/bonus
https://bet365win.example/sports/free-bet
http://sports-betting-tips.example/odds/today
https://www.freebets4u.example/offers/claim
https://best-bets-daily.example/football/free-bets
https://bingo-win-now.example/jackpot
http://cheap-viagra-online.example/buy/pills
https://www.pills-without-rx.example/order/cheap
https://pharmacy-discount-meds.example/cialis/10mg
http://buy-cheap-meds.example/checkout/pills
https://diet-pills-miracle.example/lose-weight-fast
http://www.weight-loss-miracle.example/trial/free
https://slim-fast-pill.example/order
http://male-enhancement-pill.example/buy-now
https://hot-singles-nearby.example/chat/adult
http://www.adult-cams-live.example/free/cam
https://xxx-video-tube.example/hot/clip-33
https://adultdating-xx.example/join/free
http://sexy-chat-rooms.example/cams/live
https://www.nude-cams.example/xxx/live
http://porn-tube-free.example/video/928
https://escorts-night.example/adult/listing
http://replica-watches-shop.example/rolex/cheap
https://www.cheap-replica-bags.example/sale/outlet
http://outlet-sunglasses-sale.example/cheap/90-off
https://fake-designer-shoes.example/replica/order
http://payday-loans-fast.example/apply/now
https://www.quick-cash-loan.example/no-credit-check
http://instant-loan-approval.example/apply
https://bad-credit-loans.example/cash/today
http://debt-relief-fast.example/apply-now
https://make-money-fast.example/work-from-home
http://www.earn-cash-online.example/easy/500-day
https://get-rich-crypto.example/invest/double
http://bitcoin-doubler.example/deposit/win
https://crypto-giveaway-win.example/claim/prize
http://free-iphone-prize.example/claim?id=8
https://you-won-prize.example/winner/claim
http://www.prize-winner-today.example/free/gift
https://free-gift-cards.example/claim/now
http://click-to-win.example/spin/prize
https://ads-banner-click.example/track/click?u=3
http://track.adserver-banner.example/ads/pop
https://popup-ads-network.example/banner/468x60
http://www.adtracker-click.example/pixel/track.gif
https://clicktrack-ads.example/redirect/out
http://banner-exchange-ads.example/click/72
https://ad-click-track.example/impression/banner
http://seo-links-cheap.example/buy/backlinks
https://www.buy-backlinks.example/spam/links
http://link-farm-seo.example/directory/links
https://spam-links-farm.example/page/9
http://buy-followers-cheap.example/instagram/likes
https://www.fake-followers.example/buy/10k
http://bulk-email-lists.example/spam/send
https://mass-mailer-spam.example/bulk
http://warez-crack-download.example/keygen/free
https://www.crackz-serial.example/keygen/win
http://free-keygen-crack.example/download/exe
https://torrent-warez.example/movies/free-download
http://watch-movies-free-hd.example/stream/click
https://download-free-cracked.example/apps/apk
http://driver-update-free.example/download/now.exe
https://pc-speedup-free.example/download/cleaner.exe
http://virus-alert-scan.example/warning/click
https://account-verify-login.example/secure/update
http://paypa1-secure-login.example/verify/account
https://bank-login-verify.example/update/password
http://www.win-lottery-now.example/ticket/free
https://lotto-jackpot-win.example/numbers
http://scratch-win-cash.example/play
https://spielautomaten-gratis.example/bonus/spielen
http://casino-ohne-einzahlung.example/bonus
https://www.sportwetten-bonus.example/wetten/gratis
http://kredit-ohne-schufa.example/sofort/geld
https://potenzmittel-billig.example/kaufen/rezeptfrei
http://abnehmen-pillen.example/bestellen/billig
https://casino-en-ligne-bonus.example/jouer/gratuit
http://paris-sportifs-bonus.example/cote/gratuit
https://pilules-pas-cher.example/acheter/viagra
http://credit-rapide-facile.example/argent/vite
https://www.rencontre-sexy.example/chat/adulte
http://apuestas-bono-gratis.example/casino/ganar
https://pastillas-baratas.example/comprar/viagra
http://dinero-rapido-facil.example/prestamo/ya
https://casino-tragaperras.example/bono/gratis
"""

WANTED = """
https://www.riverside-library.example/catalogue/history
https://city-library.example/en/opening-hours
http://library.oakfield.example/books/new
https://open-university-notes.example/physics/lecture-3
https://www.chemistry-department.example/courses/organic
http://math.hillcollege.example/seminar/algebra
https://astronomy-society.example/observations/2021
https://botanical-garden.example/plants/ferns
http://www.natural-history-museum.example/exhibits
https://museum-of-science.example/visit/tickets
https://archive.county-records.example/parish/1841
http://local-history.example/articles/mill-town
https://www.daily-herald.example/politics/2022/05/14/budget
http://news.valleypost.example/world/election
https://morning-chronicle.example/opinion/letters
https://weather.coastguard.example/forecast/north
http://climate-data.example/stations/0417
https://www.health-service.example/conditions/asthma
https://county-hospital.example/departments/cardiology
http://nursing-journal.example/issues/12
https://www.medical-research.example/papers/vaccines
http://public-health.example/advice/winter
https://cityschool.example/classes/timetable
http://www.primary-school.example/parents/letters
https://music-school.example/lessons/violin
https://orchestra-hall.example/concerts/season
http://theatre-royal.example/plays/hamlet
https://www.film-archive.example/directors/1930s
http://poetry-review.example/poems/spring
https://bookshop-corner.example/authors/new
https://www.cooking-at-home.example/recipes/lentil-soup
http://bread-and-butter.example/recipes/sourdough
https://kitchen-garden.example/vegetables/beans
http://www.travel-notes.example/portugal/lisbon
https://mountain-walks.example/trails/ridge
http://railway-timetable.example/lines/north
https://bicycle-club.example/routes/canal
https://www.sailing-school.example/courses/beginners
http://football-club-history.example/seasons/1974
https://chess-club.example/games/opening
http://www.running-group.example/events/marathon
https://software-docs.example/api/reference
http://code-review-notes.example/python/testing
https://www.open-source-tools.example/projects/parser
http://compiler-blog.example/2020/03/register-allocation
https://database-internals.example/articles/b-tree
http://linux-handbook.example/kernel/scheduler
https://www.statistics-course.example/lectures/regression
http://machine-learning-notes.example/posts/kernels
https://engineering-journal.example/bridges/steel
http://www.town-council.example/meetings/minutes
https://planning-office.example/applications/2023
http://tax-office.example/forms/income
https://www.parliament-records.example/debates/housing
http://court-reports.example/cases/1998
https://law-library.example/statutes/water
https://www.farmers-market.example/stalls/cheese
http://beekeeping.example/hives/spring
https://bird-watching.example/species/wren
http://www.forest-trust.example/woodlands/oak
https://river-trust.example/projects/salmon
http://geology-survey.example/maps/sheet-12
https://www.ocean-institute.example/research/currents
http://language-school.example/grammar/verbs
https://dictionary-online.example/words/etymology
http://www.philosophy-essays.example/ethics/kant
https://history-of-science.example/biographies/faraday
http://economics-review.example/trade/tariffs
https://www.small-business-advice.example/accounting
http://carpentry-workshop.example/joints/dovetail
https://knitting-patterns.example/jumpers/wool
http://www.photography-club.example/gallery/landscape
https://architecture-review.example/houses/brick
http://stadtbibliothek.example/katalog/romane
https://www.zeitung-heute.example/politik/gemeinderat
http://wetterdienst.example/vorhersage/morgen
https://universitaet-sued.example/institut/geschichte
http://www.kochbuch.example/rezepte/kartoffelsuppe
https://wanderverein.example/touren/alpen
http://bibliotheque-municipale.example/livres/romans
https://www.journal-du-matin.example/politique/budget
http://cuisine-maison.example/recettes/soupe
https://lycee-du-parc.example/cours/histoire
http://www.musee-des-arts.example/expositions
https://meteo-locale.example/previsions/demain
http://biblioteca-central.example/libros/novela
https://www.diario-local.example/noticias/ciudad
http://cocina-casera.example/recetas/sopa
https://instituto-norte.example/cursos/historia
http://museo-del-mar.example/visitas/horario
https://www.tiempo-hoy.example/pronostico/costa
http://jardin-botanico.example/plantas/rosas
"""
